"""Frozen configuration objects and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must equal the reference for identical results) -----------
# Product categories processed by the preparation job, in processing order.
CATEGORIES = (
    "Amazon_Fashion",
    "Home_and_Kitchen",
    "Books",
    "Automotive",
    "Tools_and_Home_Improvement",
    "Kindle_Store",
    "Sports_and_Outdoors",
    "Cell_Phones_and_Accessories",
    "Toys_and_Games",
    "All_Beauty",
    "Health_and_Personal_Care",
    "Industrial_and_Scientific",
    "Grocery_and_Gourmet_Food",
    "Office_Products",
    "Electronics",
    "Pet_Supplies",
    "Arts_Crafts_and_Sewing",
    "Musical_Instruments",
    "Baby_Products",
    "Handmade_Products",
    "Software",
    "Video_Games",
    "Appliances",
    "Unknown",
    "Movies_and_TV",
)

# Source fields kept from each raw product record.
SOURCE_FIELDS = (
    "main_category", "title", "average_rating", "features", "description",
    "images", "videos", "details", "rating_number",
)

# Text fields scrubbed after normalisation (tab/newline/CR, then strip).
SCRUBBED_FIELDS = ("main_category", "title", "features", "description", "details")

# Text fields passed through clean_text by the valid-entry filter.
CLEANED_FIELDS = ("title", "features", "description", "details")

# Columns of the cleaned table: eight strings, then two doubles.
CLEANED_STRING_COLUMNS = (
    "main_category", "title", "features", "description", "details",
    "images_hi_res", "images_large", "video_urls",
)
CLEANED_DOUBLE_COLUMNS = ("average_rating", "rating_number")

# Tokens a default pandas CSV read turns into null.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Per-channel image normalisation (ImageNet statistics).
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)

# Multi-value separators: training CSV and inference CSV.
LIST_SEPARATOR = " | "
PATH_SEPARATOR = ";"

# Reserved token ids of the corpus vocabulary.
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3

# Efficiency scoring constants.
REF_IMAGE_FLOPS = 390e6
REF_IMAGE_SIZE = (224, 224)
TARGET_PARAMS = 1e9
TARGET_FLOPS = 20e9
COST_EXPONENT = 0.5
EFF_ALPHA, EFF_BETA, EFF_GAMMA = 0.05, 2.0, 0.10
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PrepareConfig:
    frac: float | None = 0.2
    min_samples: int = 10000
    seed: int = 42


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 42
    test_size: float = 0.2
    rare_threshold: int = 50


@dataclass(frozen=True)
class TrainConfig:
    seed: int = 42
    batch_size: int = 32
    num_images_per_sample: int = 1
    hidden_dim: int = 512
    max_length: int = 256
    num_epochs: int = 10
    patience: int = 1
    image_size: int = 224


@dataclass(frozen=True)
class EncoderShape:
    """Sizes of the text encoder used by the analytic cost model."""

    layers: int = 6
    hidden: int = 384
    intermediate: int = 1536
    image_dim: int = 1280
    hidden_dim: int = 512
    num_outputs: int = 1


@dataclass(frozen=True)
class RuntimeConfig:
    warmup_batches: int = 5
    max_batches: int | None = None


@dataclass(frozen=True)
class Defaults:
    prepare: PrepareConfig = field(default_factory=PrepareConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    train: TrainConfig = field(default_factory=TrainConfig)
    encoder: EncoderShape = field(default_factory=EncoderShape)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)
