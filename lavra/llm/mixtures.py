"""Selections of documents in which each source has its target share of all tokens.

Method: systematic sampling. Every document of a source is expected `r` times, r being the copies that its
source needs; in an order by length, the expected copies are summed up, one random offset is added, and a
document is taken once for each whole number that its part of the sum crosses. Ordered by length, the tokens
come out as exactly as the documents do. The sums go by buckets first, so no source is gathered in one place.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Slices of each class of length, and classes for each doubling of length.
SLICES, CLASSES = 256, 8
#: Characters after which a long text is given to the tokenizer in parts, at the next blank between two letters: a
#: tokenizer's words begin there anyway, so the parts have as many tokens as the whole.
CHUNK = 100_000
_BETWEEN = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text; 0 for null."""
    if not text:
        return 0
    encoding, n, at = _encoding(path), 0, 0
    while at < len(text):
        place = _BETWEEN.search(text, at + CHUNK)
        end = place.start() if place else len(text)
        n += len(encoding.encode_ordinary(text[at:end]))
        at = end
    return n


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source and tokens of each document that has a source and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count_tokens(t, path) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.where("doc_id is not null and source is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(run, "doc_id long, source string, tokens long")


def _targets(sized: DataFrame, mixes: DataFrame, total_tokens: int | None) -> DataFrame:
    """Of each mistura and source: the share wanted among the sources that have documents, and the copies
    expected of each document. The selection is the largest in which no source passes its cap; with no cap at
    all it has as many tokens as the documents of its sources."""
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens_fonte"), F.count("*").alias("documentos")).where("tokens_fonte > 0")
    wanted = mixes.where("mistura is not null and source is not null and peso > 0").groupBy("mistura", "source").agg(F.sum(F.col("peso").cast("double")).alias("peso"), F.min("max_repeticoes").alias("limite"))
    both = wanted.join(held, "source", "left").withColumn("tokens_fonte", F.when(F.coalesce("limite", F.lit(1)) > 0, F.col("tokens_fonte")))
    mix = Window.partitionBy("mistura")
    both = both.withColumn("alvo", F.when(F.col("tokens_fonte").isNotNull(), F.col("peso") / F.sum(F.when(F.col("tokens_fonte").isNotNull(), F.col("peso"))).over(mix)))
    room = F.min(F.when(F.col("limite").isNotNull(), F.col("limite") * F.col("tokens_fonte") / F.col("alvo"))).over(mix)
    total = F.coalesce(room, F.sum("tokens_fonte").over(mix).cast("double"))
    if total_tokens is not None:
        total = F.least(total, F.lit(float(total_tokens)))
    both = both.withColumn("esperado", F.col("alvo") * total / F.col("tokens_fonte"))
    both = both.withColumn("esperado", F.least("esperado", F.coalesce(F.col("limite").cast("double"), F.lit(float("inf")))))
    return both.withColumn("peso_pedido", F.col("peso") / F.sum("peso").over(mix))


def _plan(documents: DataFrame, mixes: DataFrame, seed: int, total_tokens: int | None, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(with_tokens(documents, tokenizer).dropDuplicates(["doc_id"]), "tokens")
    targets = _targets(sized, mixes, total_tokens)
    kept = sized.where("tokens > 0").withColumns({
        "classe": F.floor(F.log2(F.col("tokens").cast("double")) * CLASSES).cast("int"),
        "fatia": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLICES)).cast("int"),
    })
    bucket = ["source", "classe", "fatia"]
    # `antes`: the documents of the source in the buckets before; the table of buckets is small for any source
    counts = kept.groupBy(*bucket).agg(F.count("*").alias("n"))
    before = counts.withColumn("antes", F.sum("n").over(Window.partitionBy("source").orderBy("classe", "fatia").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = kept.withColumn("k", F.row_number().over(Window.partitionBy(*bucket).orderBy("tokens", "doc_id"))).join(before.drop("n"), bucket)
    placed = ranked.select("doc_id", "source", "tokens", (F.coalesce("antes", F.lit(0)) + F.col("k")).alias("lugar"))
    offset = F.pmod(F.xxhash64("mistura", "source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    joined = placed.join(targets.where("esperado > 0").select("mistura", "source", "esperado"), "source")
    copies = (F.floor(F.col("lugar") * F.col("esperado") + offset) - F.floor((F.col("lugar") - 1) * F.col("esperado") + offset)).cast("int")
    chosen = joined.withColumn("copias", copies).where("copias > 0").select("mistura", "source", "doc_id", "tokens", "copias")
    return chosen, targets


def select_mixture(documents: DataFrame, mixes: DataFrame, seed: int = 7, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents chosen for each mistura: mistura, source, doc_id, tokens, copias (never more than the cap,
    where it is a whole number). Documents with a null or unlisted source or an empty text are not used;
    sources without documents, or with a cap of 0, give none, and their weight falls to the others in proportion. Weights may be on
    any scale; several rows of one mistura and source add up, and the lowest cap holds."""
    return _plan(documents, mixes, seed, total_tokens, tokenizer)[0]


def mixture_shares(documents: DataFrame, mixes: DataFrame, seed: int = 7, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """What each mistura reached: of each of its sources the share asked for, the share among the sources that
    have documents, the share of tokens reached, tokens, documents and most copies of one document."""
    chosen, targets = _plan(documents, mixes, seed, total_tokens, tokenizer)
    got = chosen.groupBy("mistura", "source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("tokens_obtidos"), F.count("*").alias("documentos_usados"), F.max("copias").alias("maior_copia"))
    joined = targets.select("mistura", "source", "peso_pedido", "alvo", "limite").join(got, ["mistura", "source"], "left")
    reached = F.coalesce("tokens_obtidos", F.lit(0)) / F.sum("tokens_obtidos").over(Window.partitionBy("mistura"))
    return joined.select("mistura", "source", "peso_pedido", "alvo", reached.alias("obtido"), F.coalesce("tokens_obtidos", F.lit(0)).alias("tokens_obtidos"), F.coalesce("documentos_usados", F.lit(0)).alias("documentos_usados"), F.coalesce("maior_copia", F.lit(0)).alias("maior_copia"), "limite")
