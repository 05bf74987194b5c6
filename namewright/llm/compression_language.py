"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import caches
from .shared import drawn

UNKNOWN = "und"
#: Bounds of the sample from which the dictionaries are made: documents a language, characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 1000
#: Bound of the languages learned: those with the most labelled documents.
LANGUAGES = 500
#: Bytes compressed at once: the dictionary, not the text's own past, explains most of so short a block.
BLOCK = 2000
LEVEL = 5
#: Scores below this are narrow margins.
NARROW = 0.02


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries, by language, of a bounded sample of the labelled documents that are not held out.

    The sample of a language: the documents first in order of md5(doc_id), of each the middle ``chars`` characters in lower
    case. Each half of it is classified by dictionaries of the other, and documents that these put elsewhere, such as wrongly
    labelled ones, are left out. Languages without a letter in their sample get none.
    """
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("__lang"))
    most = ids.groupBy("__lang").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "__lang").limit(LANGUAGES)
    most = most.select(F.col("__lang").alias("__name"), (1.25 * per_language / F.col("c") + 20 / F.col("c")).alias("__share"))
    ids = ids.join(F.broadcast(most), F.col("__lang") == F.col("__name")).filter(drawn(F.col("doc_id")) <= F.col("__share")).select("doc_id", "__lang")  # LANGUAGES rows
    first = Window.partitionBy("__lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    ids = ids.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= per_language).select(F.col("doc_id").alias("__id"), "__lang").distinct()
    few = F.broadcast(ids)  # per_language rows of each language
    text = F.lower(F.col("text").cast("string"))
    middle = F.substring(text, F.greatest(F.lit(1), ((F.length(text) - chars) / 2).cast("int")), F.lit(chars))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(few, F.col("doc_id") == F.col("__id")).select("__lang", "doc_id", middle.alias("t")).collect()
    parts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["__lang"], r["doc_id"], r["t"])):
        parts.setdefault(r["__lang"], []).append(r["t"])
    return _dictionaries(cleaned(parts))


def _dictionaries(parts: dict[str, list[str]]) -> dict[str, bytes]:
    joined = {lang: "\n".join(texts) for lang, texts in sorted(parts.items())}
    return {lang: t.encode("utf-8", "surrogatepass") for lang, t in joined.items() if any(map(str.isalpha, t))}


def cleaned(parts: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sample without texts that dictionaries of the other half put into another language.

    Languages with fewer than 8 texts stay as they are and take no part; the others are checked against each other.
    """
    large = {lang: texts for lang, texts in parts.items() if len(texts) >= 8}
    if len(large) < 2:
        return parts
    out: dict[str, list[str]] = {lang: [] for lang in large}
    for half in (0, 1):
        known = CompressionClassifier(_dictionaries({lang: texts[1 - half :: 2] for lang, texts in large.items()}))
        for lang, texts in large.items():
            out[lang] += [t for t in texts[half::2] if known.classify(t)[0] in (lang, UNKNOWN)]
    return {lang: out.get(lang) or texts for lang, texts in parts.items()}


class CompressionClassifier:
    """The language whose dictionary makes the text smallest, and the margin to the next.

    Score: by how much of the smallest size the second is larger, times 4, at most 1; 1 if only one language is known.
    Ties go to the first language in order. Null texts and texts without a letter are ``und`` with score 0.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        import zstandard

        self.names, self.block, self.coders = sorted(dictionaries), block, []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = [sum(len(c.compress(data[i : i + self.block])) for i in range(0, len(data), self.block)) for c in self.coders]
        if len(sizes) == 1:
            return self.names[0], 1.0
        order = np.argsort(sizes, kind="stable")
        return self.names[order[0]], min(1.0, 4.0 * (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep_text: bool = True) -> DataFrame:
    """docs (text, and what else it has) with lang_pred and score; columns of these names are replaced.

    Each text goes to Python once, and comes back only if ``keep_text``. Names of other columns don't matter.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != "text")]
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = [i for i, c in enumerate(docs.columns) if c in kept]
    is_text = docs.schema["text"].dataType.simpleString() == "string"
    src = plain.select(*[f"c{i}" for i in own], *([] if keep_text and is_text else [F.col(f"c{at}").cast("string").alias("t")]))
    where = own.index(at) if keep_text and is_text else len(own)

    def run(batches):
        caches.take("compression_language")
        known = CompressionClassifier(dictionaries)
        for batch in batches:
            found = [known.classify(x.as_py()) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names[: len(own)], "lang_pred", "score"])

    schema = src.select(*[f"c{i}" for i in own]).schema.add("lang_pred", "string").add("score", "double")
    return src.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; no documents, no rows.

    Without a labelled document there is no language to learn, and all are ``und``. Null texts and texts without a letter are
    ``und``; very long texts are compressed whole, a block at a time; repeated rows are predicted alike; other columns, of
    whatever name, play no part.
    """
    src = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(src, fit(docs), keep_text=False)


def keep_identified(docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """The rows of docs whose language is found by more than a narrow margin, with all their columns.

    Columns named lang_pred or score are those of docs. Rows, nulls and order as in ``identify``.
    """
    names = [f"d_{i}" if c != "text" else c for i, c in enumerate(docs.columns)]
    found = predict(docs.toDF(*names), fit(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= narrow))
    return found.select(*names).toDF(*docs.columns)
