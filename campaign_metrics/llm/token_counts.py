"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

``TokenRollup`` keeps three folders under one path of the shared storage, each partitioned by batch:

* ``ledger``: signed rows (sign 1 or -1) of (doc_id, tokenizer_version). What a document counts for now is the sum
  of its rows, so an insert adds a row, a delete adds the row's negative, a revised count adds both. It is partitioned
  further into ``BUCKETS`` by a hash of the id;
* ``deltas``: the ledger rows of the batch summed by (source, lang, tokenizer_version): additive totals;
* ``commits``: one row per batch, written last.

Readers take committed batches only. A batch is worked out against the batches before it, and its partitions are
replaced whole, so a batch that died half way is run again with the same result; a batch already committed is left
alone when it is delivered again. Batches come in rising order; an uncommitted batch older than the newest
committed one is an error, since later batches were worked out without it.

Cost: a batch reads the buckets of the ledger (ids and numbers, no texts) that hold documents it names, and aggregates
the rows of those documents only; the shuffle is by document, so a source that holds a third of all rows is spread
evenly, and the sums by group are combined map-side.
``compact`` folds all committed batches into one.

Defined cases: several changes of one document and version in a batch count as the one of largest ``seq`` (ties: a
delete after an upsert, then the largest values); deleting what is not there changes nothing; an upsert of equal
values changes nothing; null ids, sources, languages and versions are values like any other; null counts are
zero; groups whose documents are all gone are not listed; an empty batch commits and changes nothing. Changes may
have further columns; they are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import text_bytes, written
from campaign_metrics.llm.tokens import encoder, public_path

KEYS = ["doc_id", "tokenizer_version"]
GROUPS = ["source", "lang", "tokenizer_version"]
VALUES = ["source", "lang", "tokens", "chars"]
LEDGER = ("doc_id bigint, tokenizer_version string, source string, lang string, tokens bigint, chars bigint, sign int, batch bigint, "
          "bucket int")
BUCKETS = 32
SALTS = 8
DELTAS = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint, chars bigint, batch bigint"
COMMITS = "changed bigint, first bigint, batch bigint"


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class TokenRollup:
    """A rollup under ``path``; ``apply`` batches of changes, read ``totals``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("ledger", LEDGER), ("deltas", DELTAS), ("commits", COMMITS)):
            # appending no rows makes the folder and leaves what is in it
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _replace(self, df: DataFrame, name: str) -> None:
        """The batch's partition of a folder, whole."""
        parts = ["batch", "bucket"] if name == "ledger" else ["batch"]
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """Committed batches that count: those from the newest compacted one on."""
        rows = self._read("commits", COMMITS)
        return rows.filter(F.col("batch") >= (rows.agg(F.max("first")).first()[0] or 0))

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.commits().select("batch"), "batch", "left_semi")

    def current(self) -> DataFrame:
        """What every counted document counts for now."""
        return self._net(self._committed("ledger", LEDGER))

    def _current_of(self, named: DataFrame) -> DataFrame:
        """What the documents of ``named`` (``KEYS``, one row each) count for now: only their buckets are read."""
        touched = [r.bucket for r in named.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
        ledger = self._committed("ledger", LEDGER).filter(F.col("bucket").isin(touched)).alias("o")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEYS]
        return self._net(ledger.join(named.alias("n"), same[0] & same[1], "left_semi"))

    @staticmethod
    def _net(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS, *VALUES).agg(F.sum("sign").alias("sign")).filter("sign <> 0").drop("sign")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens, chars of all committed batches."""
        sums = [F.sum(c).cast("bigint").alias(c) for c in ("docs", "tokens", "chars")]
        return self._committed("deltas", DELTAS).groupBy(*GROUPS).agg(*sums).filter("docs <> 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes`` (doc_id, tokenizer_version, source, lang, tokens, chars, deleted boolean, seq long).

        True if committed now, False if it was before.
        """
        newest = self._read("commits", COMMITS).agg(F.max("batch"), F.max(F.col("batch") == batch)).first()
        if newest[1]:
            return False
        if newest[0] is not None and batch < newest[0]:
            raise ValueError(f"batch {batch} comes after batch {newest[0]} was committed")
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        counts = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("tokens", "chars")]
        last = changes.groupBy(*KEYS).agg(F.max(F.struct(
            F.coalesce(F.col("seq"), F.lit(0)).alias("seq"), gone.alias("deleted"), "source", "lang", *counts)).alias("c"))
        named = last.select(*KEYS, F.col("c.deleted").alias("deleted"), *[F.col(f"c.{c}").alias(c) for c in VALUES])
        named = written(named, "token-changes")
        old = self._current_of(named)
        new = named.filter("not deleted").drop("deleted")
        rows = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
        # equal values on both sides cancel out: the sum of their signs is zero
        net = rows.groupBy(*KEYS, *VALUES).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        self._commit(batch, net, 0)
        return True

    def _commit(self, batch: int, net: DataFrame, first: int) -> None:
        # dealt by bucket and a salt, so that a task writes few files and a bucket is written by many tasks
        ledger = net.withColumn("batch", F.lit(batch).cast("bigint")).withColumn("bucket", _bucket())
        self._replace(ledger.repartition("bucket", F.pmod(F.hash("doc_id"), F.lit(SALTS))), "ledger")
        signed = lambda c: F.sum(F.col("sign") * c).cast("bigint")
        mine = self._read("ledger", LEDGER).filter(F.col("batch") == batch)
        self._replace(mine.groupBy(*GROUPS, "batch").agg(
            signed(F.lit(1)).alias("docs"), signed(F.col("tokens")).alias("tokens"), signed(F.col("chars")).alias("chars")), "deltas")
        one = self.spark.range(1).select(F.lit(mine.count()).cast("bigint").alias("changed"), F.lit(first).cast("bigint").alias("first"),
                                         F.lit(batch).cast("bigint").alias("batch"))
        self._replace(one, "commits")

    def compact(self, batch: int) -> bool:
        """Commit ``batch`` as the net of all before it; readers start from it."""
        newest = self._read("commits", COMMITS).agg(F.max("batch"), F.max(F.col("batch") == batch)).first()
        if newest[1]:
            return False
        if newest[0] is not None and batch < newest[0]:
            raise ValueError(f"batch {batch} comes after batch {newest[0]} was committed")
        self._commit(batch, self.current().withColumn("sign", F.lit(1)), batch)
        return True


def token_counter(path: str):
    """Tokens of whole texts by a tokenizers file that drops white space."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path)
        return pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")

    return count


def counted_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, words, tokens, chars and the text's digest, from one pass over the texts.

    A null text counts nothing and is a copy of an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # words by counting their starts: no array of a long text's words is built
    words = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", ""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", words.cast("bigint").alias("words"),
        token_counter(tokenizer or public_path("word_bpe_49k.json"))(text_bytes()).alias("tokens"),
        F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("digest"))


def copies(counted: DataFrame) -> DataFrame:
    """Ids of documents whose text another document of smaller id has; the list of those that stay is joined by id."""
    stay = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return counted.filter("doc_id is not null").join(stay, "doc_id", "left_anti")


def _changes(rows: DataFrame, version: str, tokens: str, deleted: bool = False) -> DataFrame:
    return rows.select("doc_id", F.lit(version).alias("tokenizer_version"), "source", "lang", F.col(tokens).alias("tokens"),
                       "chars", F.lit(deleted).alias("deleted"), F.lit(0).cast("bigint").alias("seq"))


def _first_and_revised(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words as first counts under both versions, then token counts in their place."""
    first = _changes(counted, "word_bpe_49k", "words").unionByName(_changes(counted, "words", "words"))
    return first, _changes(counted, "word_bpe_49k", "tokens")


def roll_up_documents(rollup: TokenRollup, docs: DataFrame, tokenizer: str | None = None) -> None:
    """Three batches: words as first counts of every document, revised and joined by token counts, copies deleted.

    The totals are those of distinct texts; ``roll_up_rows`` counts every row.
    """
    counted = written(counted_documents(docs, tokenizer), "token-counts")
    first, revised = _first_and_revised(counted)
    gone = copies(counted)
    deleted = _changes(gone, "word_bpe_49k", "tokens", True).unionByName(_changes(gone, "words", "words", True))
    for batch, rows in ((1, first), (2, revised), (3, deleted), (2, revised)):  # the last is a second delivery
        rollup.apply(batch, rows)


def roll_up_rows(rollup: TokenRollup, docs: DataFrame, tokenizer: str | None = None, withdraw: bool = False) -> None:
    """Two batches over every row of ``docs``, copies, repeated ids and null ids included; with ``withdraw``, two more that
    delete all copies and insert them again.

    The ledger's key is a number of the row's own, given before the counts are written, in place of its doc_id.
    """
    numbered = docs.withColumn("doc_id", F.monotonically_increasing_id())
    counted = written(counted_documents(numbered, tokenizer), "token-counts")
    first, revised = _first_and_revised(counted)
    batches = [(1, first), (2, revised), (2, revised)]  # a second delivery
    if withdraw:
        gone = copies(counted)
        for batch, deleted in ((3, True), (4, False), (4, False)):
            batches.append((batch, _changes(gone, "word_bpe_49k", "tokens", deleted).unionByName(_changes(gone, "words", "words", deleted))))
    for batch, rows in batches:
        rollup.apply(batch, rows)
