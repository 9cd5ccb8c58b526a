"""Names and patterns that files and logs hold, so results depend on them being these."""

#: Log lines that match any of these are noise.
NOISE_PATTERNS = [
    r"Unable to register cu(?:FFT|DNN|BLAS) factory",
    r"All log messages before absl::InitializeLog\(\) is called are written to STDERR",
    r"gpu_timer\.cc:\d+\] Skipping the delay kernel, measurement accuracy will be reduced",
    r".*\(ignoring feature\)",
]

#: Variants of input images: name, folder, settings file, channels.
VARIANTS = [
    ("PPL", "PPL", "PPL.yaml", 1),
    ("PPLPPXblend", "PPLPPXblend", "PPLPPXblend.yaml", 1),
    ("PPL+PPXblend", "PPL+PPXblend", "PPL_PPXblend.yaml", 6),
    ("PPL+AllPPX", "PPL+AllPPX", "PPL+AllPPX.yaml", 32),
]

#: A model whose name holds the text takes these images; the first text that fits counts.
MODEL_INPUTS = [
    ("PPL+AllPPX", 7, "_PPL,_PPX1,_PPX2,_PPX3,_PPX4,_PPX5,_PPX6"),
    ("PPL+PPXblend", 2, "_PPL,_PPXblend"),
    ("PPLPPXblend", 1, "_PPLPPXblend"),
    ("PPL", 1, "_PPL"),
]

#: Names of runs as shown, replaced in this order.
RUN_NAMES = {"PPL+AllPPX": "PPL+XPL-Stack", "PPL+PPXblend": "PPL+XPL-Comp", "PPLPPXblend": "Full-Comp"}
