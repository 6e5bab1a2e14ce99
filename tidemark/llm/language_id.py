"""Language identification by Bayesian fusion of evidence.

For each language the posterior is the product of
  - the text's likelihood under a byte-trigram model, fitted on a bounded sample of labelled rows,
  - P(declared | language), of what the markup or the table declares,
  - P(suffix | language), of the address's last label,
  - P(language | host), smoothed along the hierarchy host, registered domain (last two labels), all rows.
The last three come from grouped counts over all rows, by the language that the text alone suggests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import AT_ONCE, flat, lean, lowered, runs
from tidemark.llm.common import checkpoint
from tidemark.llm.url_filter import host_of

#: Labelled distinct texts that the trigram model is fitted on, at most, chosen by hash.
FIT_ROWS = 2000
BUCKETS = 1 << 16
#: Overlapping trigrams are not independent: their joint evidence counts a third.
TEMPER = 1 / 3
#: Strength of a host's and a domain's prior, in rows, and of the smoothing of declarations and suffixes.
HOST_ROWS, DOMAIN_ROWS, SPREAD = 20.0, 50.0, 1.0
LEAST_POSTERIOR = 0.5


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # [language, bucket], float32


def _codes(data: np.ndarray) -> np.ndarray:
    """A bucket for each three bytes; 0 for those without a letter (ASCII, or any byte above) in the middle."""
    d = data.astype(np.uint32)
    code = (d[:-2] * np.uint32(40503) + d[1:-1] * np.uint32(2654435761) + d[2:] * np.uint32(97531)) >> np.uint32(7)
    middle = d[1:-1]
    return np.where(((middle >= 97) & (middle <= 122)) | (middle >= 128), code % np.uint32(BUCKETS - 1) + 1, 0)


def _windows(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each) piece by piece, so that one very long text takes no more memory; trigrams of a text only."""
    for low in range(0, max(len(data) - 2, 0), AT_ONCE):
        code = _codes(lowered(data[low : low + AT_ONCE + 2]))
        first, third = (np.searchsorted(at, low + np.arange(len(code)) + k, "right") - 1 for k in (0, 2))
        keep = (first == third) & (code > 0)
        yield code[keep], first[keep]


def fit(docs: DataFrame, text: str, label: str, rows: int = FIT_ROWS) -> TextModel:
    """The model from at most `rows` distinct labelled texts: those with the smallest hashes. Whole texts are counted."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.col(label) != "")).select(F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit("fit"), F.col(text)).alias("h"))
    last = labelled.select("l", "h").distinct().orderBy("h", "l").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    sample = labelled.where(F.col("h") <= last).dropDuplicates(["l", "h"])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(0).to_pylist()
            data, at = flat(b.column(1))
            for code, of in _windows(data, at):
                for name in set(names):
                    mine = np.array([x == name for x in names])[of]
                    sums[name] = sums.get(name, np.zeros(BUCKETS, np.int64)) + np.bincount(code[mine], minlength=BUCKETS)
        for name, c in sums.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k, pa.int64()), pa.array(c[k], pa.int64())], ["l", "k", "n"])

    found = sample.select("l", "t").mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n")).collect()  # languages * BUCKETS at most
    names = sorted({r[0] for r in found})
    c = np.full((len(names), BUCKETS), 0.5)
    for name, k, n in found:
        c[names.index(name), k] += n
    return TextModel(names, np.log(c / c.sum(1, keepdims=True)).astype(np.float32))


def text_evidence(docs: DataFrame, text: str, model: TextModel, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep, _n (trigrams) and _log_likelihood (array, a language each) for every row."""
    table, names, kinds = model.log_p, list(keep), [f for f in docs.select(*[c.alias(k) for k, c in keep.items()]).schema]

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, all_at = flat(b.column(0))
            for lo, hi in runs(np.diff(all_at)):
                at, rows = all_at[lo : hi + 1] - all_at[lo], hi - lo
                total, n = np.zeros((len(table), rows)), np.zeros(rows, np.int64)
                for code, of in _windows(data[all_at[lo] : all_at[hi]], at):
                    n += np.bincount(of, minlength=rows)
                    for k, row in enumerate(table):
                        total[k] += np.bincount(of, row[code], minlength=rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array((total.T * TEMPER).ravel()), max(len(table), 1)).cast(pa.list_(pa.float64())) if len(table) else pa.array([[]] * rows, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, rows).columns[1:], pa.array(n), lists], [*names, "_n", "_log_likelihood"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    return docs.select(F.col(text).alias("_text"), *[c.alias(k) for k, c in keep.items()]).mapInArrow(score, StructType([*kinds, StructField("_n", LongType()), StructField("_log_likelihood", ArrayType(DoubleType()))]))


def _first(scores: Column, names: list[str]) -> Column:
    """The language of the largest score; of equals the first by name."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))


def identify(docs: DataFrame, text: str, keep: dict[str, Column], declared: Column | None = None, host: Column | None = None, url: Column | None = None, model: TextModel | None = None, label: str | None = None, accepted: list[str] | None = None, least: float = LEAST_POSTERIOR) -> DataFrame:
    """keep, then language, posterior and rejected, for every row of docs.

    host is a host's name, or comes from url. Rows without a trigram (null, empty or letterless texts) have no language
    unless what is declared or the address speaks; their language then comes from those alone. Rejected are rows whose
    best posterior is under `least`, whose language is not among accepted, or that have no letters. A null declaration
    or host is no evidence. Equal posteriors go to the first language by name. Without any labelled row to fit on, no
    row has a language and none is rejected. Repeated rows stay and an empty table gives an empty one.
    """
    none = F.lit(None).cast("string")
    host = host if host is not None else F.nullif(host_of(url), F.lit("")) if url is not None else none
    declared = F.nullif(F.lower(F.substring_index(F.substring_index(F.trim(declared), "-", 1), "_", 1)), F.lit("")) if declared is not None else none
    model = model or fit(docs, text, label)
    names = model.languages
    host_name = F.substring_index(host, ":", 1)
    domain = F.when(F.instr(host_name, ".") > 0, F.substring_index(host_name, ".", -2))
    suffix = F.when(F.instr(host_name, ".") > 0, F.substring_index(host_name, ".", -1))
    seen = text_evidence(docs, text, model, keep | {"_declared": declared, "_suffix": suffix, "_host": host_name, "_domain": domain})
    if not names:
        return seen.select(*keep, none.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("rejected"))
    seen = checkpoint(seen.withColumn("_by_text", F.when(F.col("_n") > 0, _first(F.col("_log_likelihood"), names))))
    spoke = seen.where("_by_text is not null")
    counts = lambda c: [F.sum((F.col("_by_text") == l).cast("long")).alias(f"_c{k}") for k, l in enumerate(names)]  # noqa: E731, E741, ARG005
    total = spoke.agg(*counts(None)).first()
    all_rows = [float(x or 0) for x in total]
    prior = [(c + 1) / (sum(all_rows) + len(names)) for c in all_rows]

    def given(column: str) -> DataFrame:
        """(column, _e_column): log P(value | language), smoothed towards the value's share of all rows."""
        by = spoke.where(F.col(column).isNotNull()).groupBy(column).agg(*counts(None))
        of = [float(x or 0) for x in spoke.where(F.col(column).isNotNull()).agg(*counts(None)).first()]
        share = (sum(F.col(f"_c{k}") for k in range(len(names))) + F.lit(0.5)) / F.lit(sum(of) + 1.0)
        return by.select(column, F.array(*[F.log((F.col(f"_c{k}") + SPREAD * share) / (of[k] + SPREAD)) for k in range(len(names))]).alias(f"_e{column}"))

    by_domain = spoke.where("_domain is not null").groupBy("_domain").agg(*counts(None))
    n_domain = sum(F.col(f"_c{k}") for k in range(len(names)))
    by_domain = by_domain.select("_domain", F.array(*[(F.col(f"_c{k}") + DOMAIN_ROWS * prior[k]) / (n_domain + DOMAIN_ROWS) for k in range(len(names))]).alias("_p_domain"))
    by_host = spoke.where("_host is not null").groupBy("_host", "_domain").agg(*counts(None)).join(by_domain, "_domain", "left")
    parent = F.coalesce("_p_domain", F.array(*map(F.lit, prior)))
    by_host = by_host.select("_host", F.array(*[F.log((F.col(f"_c{k}") + HOST_ROWS * F.element_at(parent, k + 1)) / (n_domain + HOST_ROWS)) for k in range(len(names))]).alias("_e_host"))
    out = seen.join(given("_declared"), "_declared", "left").join(given("_suffix"), "_suffix", "left").join(by_host, "_host", "left")
    nothing = F.array(*[F.lit(0.0)] * len(names))
    at_large = F.array(*[F.lit(float(np.log(p))) for p in prior])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = add(add(F.col("_log_likelihood"), F.coalesce("_e_declared", nothing)), add(F.coalesce("_e_suffix", nothing), F.coalesce("_e_host", at_large)))
    out = out.withColumn("_score", score)
    # Divided by the largest first, so that the sum is at least 1.
    weights = F.transform("_score", lambda x: F.exp(x - F.array_max("_score")))
    speaks = (F.col("_n") > 0) | F.coalesce(F.col("_e_declared"), F.col("_e_suffix"), F.col("_e_host")).isNotNull()
    posterior = F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    out = out.select(*keep, "_n", F.when(speaks, _first(F.col("_score"), names)).alias("language"), F.when(speaks, posterior).alias("posterior"))
    wanted = F.col("language").isin(*accepted) if accepted is not None else F.lit(True)
    bad = (F.col("_n") == 0) | F.col("language").isNull() | (F.col("posterior") < least) | ~wanted
    return out.select(*keep, "language", "posterior", F.coalesce(bad, F.lit(True)).alias("rejected"))
