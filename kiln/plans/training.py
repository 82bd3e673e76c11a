"""Training-data side of the regression job.

cleaned table -> rare strata (P2) -> stratified 80/10/10 split (P3/P4) ->
training-split weight mean (W1) and weights (W2) -> four-part text (T2) ->
image candidates (I1) and landed images (I3-I5) -> labels (W3). Per epoch:
seeded shuffle of training rows (P6), token ids (T4), batches (T5/T7).
Evaluation: per-epoch history (V7), best epoch and early stop (V8/V9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.config import SplitConfig, TrainConfig
from kiln.operators import evaluation, images, splits, text_features, weights
from kiln.sources.csv import default_na


def training_table(cleaned: DataFrame, image_table: DataFrame | None = None,
                   split_cfg: SplitConfig = SplitConfig(), train_cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """Split, weights, text, images and labels of every cleaned record. The
    cleaned file is read with the default-NA dialect here: its 19 tokens (a
    product titled ``NA``) become null before anything else sees them."""
    cleaned = default_na(cleaned)
    # ``cleaned`` is the parquet stage table, so the split need not stage it again.
    s = splits.rare_stratified_split(cleaned, "average_rating", split_cfg.rare_threshold,
                                     seed=split_cfg.seed, test_size=split_cfg.test_size, stage=False)
    s = weights.add_weights(s, weights.mean_log_count(s))
    s = text_features.add_text(s, with_details=False, out="question")
    s = s.withColumn("candidates", images.candidate_urls(k=train_cfg.num_images_per_sample))
    if image_table is not None:
        s = images.attach_images(s, image_table, k=train_cfg.num_images_per_sample)
        s = s.withColumn("has_images_value", images.has_images_value())
    return weights.label_defaults(s)


def epoch_batches(table: DataFrame, vocab: DataFrame, epoch: int, split: str = "train",
                  cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """Batches of one split for one epoch: the training split in its seeded
    per-epoch order, other splits in id order."""
    rows = table.filter(F.col("split") == split)
    x = text_features.with_token_ids(rows.select("item_id", "label", "weight", "question"), vocab, "question", cfg.max_length).drop("question")
    if split == "train":
        x = splits.shuffle_rows(x.withColumn("split", F.lit("train")), epoch, seed=cfg.seed)
        order = ["shuffle_key", "item_id"]
    else:
        order = ["item_id"]
    idx = text_features.batch_index(x, order, cfg.batch_size)
    return text_features.assemble_batches(idx, "item_id", "input_ids", extra=("label", "weight"))


def history_report(predictions: DataFrame, lr: DataFrame | None = None, patience: int = 1):
    """Epoch history and the best/stop summary per run."""
    h = evaluation.epoch_history(predictions, lr)
    return h, evaluation.best_and_stop(h, "val_plcc", patience)
