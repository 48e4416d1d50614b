"""Fixed values that results must agree on."""

SEED = 42
TRAINING_SEEDS = (42, 123, 456)
DECISION_THRESHOLD = 0.5
LABEL_REAL = 0
LABEL_FAKE = 1
REAL = "real"

# Generator domain.
DIFFUSION_GENERATORS = (
    "glide", "stable_diffusion_1_3", "stable_diffusion_1_4", "stable_diffusion_2",
    "stable_diffusion_xl", "stable_diffusion_3", "flux", "dalle2", "dalle3",
    "adobe_firefly",
)
HELD_OUT_GENERATORS = ("gigagan", "midjourney_v5", "midjourney_v6_1")
TRAINING_GENERATORS = ("latent_diffusion",)
BENCHMARK_GENERATORS = DIFFUSION_GENERATORS + HELD_OUT_GENERATORS
FUSION_CALIBRATION_GENERATORS = ("glide",)

# Split ratios in whole percent, in allocation order.
SPLIT_PERCENT = {"train": 70, "val": 15, "test": 15}
FUSION_REAL_PERCENT = 30

# Techniques.
SOURCE_TECHNIQUES = ("T01", "T02", "T03", "T04")
FUSION = "T05"
TECHNIQUE_ORDER = SOURCE_TECHNIQUES + (FUSION,)
TECHNIQUE_NAMES = {
    "T01": "RGB co-occurrence CNN",
    "T02": "Spectral learning",
    "T03": "Benford law on DCT",
    "T04": "Projective geometry",
    "T05": "Late fusion",
}
COMPONENTS = ("perspective_fields", "line_segment", "object_shadow")

# Column names accepted in an external score file, by priority.
SCORE_COLUMNS = ("spai", "score", "prediction", "probability", "pred", "spai_score", "output")
PATH_COLUMNS = ("image", "path", "filename", "file", "image_path")

# Column names of component tables and the mark of failure logs.
NAME_COLUMNS = ("arquivo", "name")
LEGACY_SCORE_COLUMNS = ("escore_t04", "legacy_score")
FAILURE_LOG_MARK = "falhas"

# Status of a run.
STATUS_OK = "ok"
STATUS_FAILED = "erro"

# Archive folder name -> generator id.
GENERATOR_MAP = {
    "glide": "glide",
    "stable-diffusion-1-3": "stable_diffusion_1_3",
    "stable-diffusion-1-4": "stable_diffusion_1_4",
    "stable-diffusion-2": "stable_diffusion_2",
    "stable-diffusion-xl": "stable_diffusion_xl",
    "dalle2": "dalle2",
    "dalle3": "dalle3",
    "firefly": "adobe_firefly",
    "midjourney-v5": "midjourney_v5",
    "flux": "flux",
    "gigagan": "gigagan",
    "midjourney-v6.1": "midjourney_v6_1",
    "stable-diffusion-3": "stable_diffusion_3",
}
ARCHIVE_PREFIX = "synthbuster"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")

# Published AUC and native side (pixels) per generator.
PUBLISHED = (
    ("glide", 0.902, 256),
    ("stable_diffusion_1_3", 0.996, 512),
    ("stable_diffusion_1_4", 0.996, 512),
    ("flux", 0.830, 896),
    ("dalle2", 0.911, 1024),
    ("stable_diffusion_2", 0.965, 1000),
    ("stable_diffusion_xl", 0.974, 1000),
    ("stable_diffusion_3", 0.759, 1024),
    ("gigagan", 0.854, 1024),
    ("midjourney_v5", 0.945, 1100),
    ("midjourney_v6_1", 0.840, 1040),
    ("dalle3", 0.902, 1080),
    ("adobe_firefly", 0.960, 2050),
)
PUBLISHED_TOLERANCE_PP = 5.0
NORMALISED_SIDE = 256

# Robustness conditions (kind, level) in report order.
CONDITIONS = (
    ("clean", "clean", 0.0),
    ("jpeg_q50", "jpeg", 50.0), ("jpeg_q70", "jpeg", 70.0), ("jpeg_q85", "jpeg", 85.0),
    ("noise_sigma1", "noise", 1.0), ("noise_sigma3", "noise", 3.0), ("noise_sigma5", "noise", 5.0),
    ("resize_50", "resize", 0.50), ("resize_70", "resize", 0.70), ("resize_85", "resize", 0.85),
)

# Upload rules.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
UPLOAD_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")

# Benford feature grid.
BENFORD_BASES = (10, 20, 40, 60)
BENFORD_QUALITIES = (80, 85, 90, 95, 100)
BENFORD_FREQUENCIES = 9
DIVERGENCES = ("jensen_shannon", "renyi", "tsallis")
RENYI_ALPHA = 0.5
TSALLIS_Q = 0.5
EPS = 1e-12
# Raster index of AC positions 1..9 in zigzag order of an 8x8 block.
AC_POSITIONS = (1, 8, 16, 9, 2, 3, 10, 17, 24)
COOCCURRENCE_SCALE = 1e4

# Standard luminance quantisation table (JPEG Annex K), raster order.
LUMA_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)

# Forest grid, fusion forest size, latency limit, mask thresholds.
FOREST_TREES = (100, 200, 500)
FOREST_DEPTHS = (10, 20, None)
CV_FOLDS = 5
LATENCY_LIMIT_MS = 30_000.0
MASK_THRESHOLD = 0.5
EMPTY_CONTENT_LEVEL = 20.0
CONFOUNDER_DELTA = 0.03
MIN_INVERSION_SAMPLES = 30
IMBALANCE_RATIO = 1.5
