"""Language identification by compression.

Each language gets a raw-content zstandard dictionary cut from labelled texts.
The whole text is encoded with every dictionary, in blocks of ``BLOCK`` bytes
so that late parts of a long text lean on the dictionary as much as its start,
and gets the language of the smallest total; a narrow margin between the two
smallest is rejected.

Fit: every language gets a dictionary, of one ``PIECE_CHARS`` piece, at a
hash-chosen place, of up to ``DOCS_PER_LANG`` hash-sampled documents; with very
many languages each has fewer, at least one, so that ``MAX_FIT_DOCS`` hold them
all. These bounds are parameters; scoring reads every text.

Defined results: null texts and texts without any letter are ``und`` with
score 0 and are rejected, as is everything when there is nothing to learn
from. Equal sizes go to the alphabetically first language and are rejected.
Repeated rows give repeated, equal results. A kept column named like a result
column (lang_pred, score, accepted, in any case) gives way to it;
``accepted_rows`` adds no column and keeps all. Labels, sources and ids are never
inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from kiln.llm.helpers import numbered, quoted
from kiln.operators.joins import bounded_broadcast, materialize

DOCS_PER_LANG = 600
MAX_FIT_DOCS = 120_000       # over all languages
PIECE_CHARS = 300
BLOCK = 1000
RESULTS = ("lang_pred", "score", "accepted")
MIN_MARGIN = 0.003           # (second - best) / second, below which a text is rejected


def fit_dictionaries(docs: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang",
                     id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG,
                     piece_chars: int = PIECE_CHARS, max_docs: int = MAX_FIT_DOCS) -> dict[str, bytes]:
    """{language: dictionary content} from the labelled rows that meet ``where``."""
    rows = docs.filter(where & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("dict")).alias("h"))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")))
    langs = counts.count()
    if not langs:
        return {}
    docs_per_lang = max(1, min(docs_per_lang, max_docs // langs))
    # Thin each language by hash to about twice its bound, then take exactly
    # the first rows in hash order: the window sees a bounded number of rows.
    cut = F.least(F.lit(1_000_000), F.floor(F.lit(2_000_000 * docs_per_lang) / F.col("n")) + 1)
    width = F.greatest(F.char_length("text") - piece_chars, F.lit(0)) + 1
    thin = (rows.join(bounded_broadcast(counts, materialized=True), "lang").filter(F.pmod(F.col("h"), F.lit(1_000_000)) < cut)
            .select("lang", "h", F.substring(F.col("text"), (F.pmod(F.hash("h"), width) + 1).cast("int"), F.lit(piece_chars)).alias("piece")))
    w = Window.partitionBy("lang").orderBy("h", "piece")
    picked = thin.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= docs_per_lang).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["rn"])):
        out.setdefault(r["lang"], []).append(r["piece"].lower())
    return {lang: "\n".join(v).encode() for lang, v in sorted(out.items())}


def encoders(dictionaries: dict[str, bytes]) -> list:
    """Compressors that search the whole dictionary for matches of four bytes
    or more (the fast presets miss short matches and confuse languages)."""
    out = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters(
            window_log=19, strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=4, chain_log=18, hash_log=18,
            target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def classify(text: str | None, langs: list[str], enc: list, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
    """(language, score in 0..1, accepted) of one whole text."""
    if text is None or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0, False
    raw = text.lower().encode("utf-8", "replace")
    sizes = [sum(len(e.compress(raw[i:i + BLOCK])) for i in range(0, len(raw), BLOCK)) for e in enc]
    order = sorted(range(len(langs)), key=sizes.__getitem__)
    best = order[0]
    if len(langs) == 1:
        return langs[best], 1.0, True
    second = sizes[order[1]]
    margin = (second - sizes[best]) / second
    return langs[best], min(1.0, 0.5 + 5 * margin) if margin else 0.0, margin >= min_margin


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
                id_col: str = "doc_id", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per document: ``keep`` columns (default the id), lang_pred,
    score, accepted."""
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in RESULTS]
    langs = list(dictionaries)
    cols = list(dict.fromkeys([*keep, text_col]))
    src = docs.select(*quoted(cols))
    at = {c: i for i, c in enumerate(cols)}
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("accepted", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(dictionaries)
        for b in batches:
            res = [classify(t.as_py(), langs, enc, min_margin) for t in b.column(at[text_col])]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(at[c]) for c in keep], pa.array([r[0] for r in res], pa.string()),
                 pa.array(np.array([r[1] for r in res], dtype=np.float64)),
                 pa.array([r[2] for r in res], pa.bool_())],
                names=[*keep, "lang_pred", "score", "accepted"])

    return docs.select(*numbered(cols)).mapInArrow(run, schema)


def accepted_rows(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
                  min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents, all columns as they are, whose language is accepted."""
    langs, cols = list(dictionaries), docs.columns
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(dictionaries)
        for b in batches:
            ok = pa.array([classify(t.as_py(), langs, enc, min_margin)[2] for t in b.column(at)], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns, names=cols).filter(ok)

    return docs.select(*numbered(cols)).mapInArrow(run, docs.schema)
