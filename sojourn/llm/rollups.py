"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A batch of changes says for documents and versions how many tokens they have now, or that they are gone. It is turned into signed rows against
what the batches before it left: a new count adds, a revised one takes the old count away and adds the new one (also when the
document moved to another source or language), a deleted one takes its count away. A batch is stored as its signed rows and their sums, in
folders named by its number, and totals are the sums over all batches.

A commit is one small file that names the folders of a batch, written after them: readers see all of a batch or nothing of it. Committing a batch
again replaces it as a whole, also by nothing where its changes turn out to change nothing; but the batches after it were weighed against it, so once there
are any, only the same rows are accepted again. Batches are committed in ascending order. Only documents that a batch names are folded from the
history, so a commit shuffles what it changes; ``compact`` folds the history itself. The sums of a batch are folded before they are shuffled, so a
source that holds most documents takes no task longer.

Nulls: a null source, language or version is a value like any other, a null ``doc_id`` as well; a null count is zero. When a batch names a
document and version more than once, the largest count holds, and a deletion only counts if there is no count. Changes that
delete what is not there change nothing. Texts are not read here, so empty and very long ones are counts like any other; empty tables give no totals.
Extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import statistics
from sojourn.llm.scratch import shared_folder, written
from sojourn.sources.commits import CommitLog

GROUP = ["source", "lang", "version"]
DOCUMENT = ["doc_id", "version"]
SIGNED = "doc_id long, source string, lang string, version string, n_docs long, n_tokens long"
SUMS = "source string, lang string, version string, n_docs long, n_tokens long"


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter("n_docs <> 0 or n_tokens <> 0")


class TokenTotals:
    """Signed rows and sums of all batches under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._log = CommitLog(spark, f"{self.folder}/commits")

    def _batches(self) -> tuple[int, dict[int, dict]]:
        """Number of the last commit, and what it knows of each batch."""
        number, entry = self._log.latest() or (0, {})
        return number, {int(k): v for k, v in entry.items()}

    def _read(self, kind: str, batches: list[dict]) -> DataFrame:
        schema = SIGNED if kind == "rows" else SUMS
        paths = [b[kind] for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, number: int, batches: dict[int, dict], batch: int, signed: DataFrame, base: bool = False) -> None:
        """Write a batch's rows and sums and commit them, unless the same rows are there already."""
        folder = f"{self.folder}/data/{batch}-{uuid.uuid4().hex}"
        new = {kind: f"{folder}/{kind}" for kind in ("rows", "sums")}
        signed.select(*[c.split()[0] for c in SIGNED.split(", ")]).write.parquet(new["rows"])
        rows = self._read("rows", [new])
        n, hashes = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
        new |= {"mark": f"{n} {hashes}", "base": base}
        old = batches.get(batch)
        if not base and old and old["mark"] == new["mark"]:
            return
        if not base and max(batches, default=batch) > batch:
            raise ValueError(f"batches after {batch} were weighed against other rows than these")
        _summed(rows, GROUP).write.parquet(new["sums"])
        kept = {} if base else batches
        self._log.add(number + 1, {str(k): v for k, v in {**kept, batch: new}.items()})

    def held(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """Count of every document and version, or of those named in ``of``, after all batches or those with lower numbers."""
        batches = [b for k, b in self._batches()[1].items() if before is None or k < before]
        rows = self._read("rows", batches)
        if of is not None:
            rows = rows.join(of.select(*DOCUMENT), _same(rows, of, DOCUMENT), "left_semi")
        return _summed(rows, [*DOCUMENT, "source", "lang"]).filter("n_docs <> 0")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Store a batch: ``doc_id, source, lang, version, n_tokens, deleted``."""
        number, batches = self._batches()
        base = max((k for k, b in batches.items() if b["base"]), default=None)
        if base is not None and batch <= base:
            raise ValueError(f"the batches up to {base} are folded")
        counts = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
        gone = F.coalesce(F.col("deleted"), F.lit(False))
        ranked = F.max(F.struct((~gone).alias("there"), F.when(gone, F.lit(0)).otherwise(counts).alias("n"), "source", "lang")).alias("x")
        asked = changes.groupBy(*[F.col(k) for k in DOCUMENT]).agg(ranked).select(*DOCUMENT, "x.*")
        asked = written(asked, "changes")
        new = asked.filter("there").select("doc_id", "source", "lang", "version", F.lit(1).cast("long").alias("n_docs"), F.col("n").alias("n_tokens"))
        old = self.held(batch, asked)
        old = old.select("doc_id", "source", "lang", "version", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
        # A count that was the same before adds up to nothing and is not stored.
        self._write(number, batches, batch, _summed(new.unionByName(old), ["doc_id", *GROUP]))

    def compact(self) -> None:
        """Fold all batches to one, so that later commits read each document once. The batches before can then not be replaced any more."""
        number, batches = self._batches()
        if len(batches) > 1:
            self._write(number, batches, max(batches), _summed(self._read("rows", list(batches.values())), ["doc_id", *GROUP]), base=True)

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` from the sums of the batches."""
        return _summed(self._read("sums", list(self._batches()[1].values())), GROUP)


# The two ways to count tokens that the query keeps totals of.
WORDS, SIGNS = "words-1", "signs-1"
SIGN_PATTERN = r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"


def corpus_totals(docs: DataFrame) -> DataFrame:
    """Totals of a corpus after its documents came in, were counted by a second version, lost their repeated lines and their copies.

    Batch 1 counts all texts by words, batch 2 by words and signs, batch 3 has the counts of both after each text keeps one of its equal lines, and
    batch 4 deletes all but the first of equal texts. Batch 2 is committed a second time, which changes nothing.
    """
    spark = docs.sparkSession
    text = statistics.filled(F.col("text"))
    once = F.array_join(F.array_distinct(F.split(text, "\n", -1)), "\n")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(text).alias("key"), text.alias("text"), once.alias("once"))
    signs = lambda c: F.regexp_count(F.col(c), F.lit(SIGN_PATTERN)).cast("long")
    counted = rows.select(
        "doc_id", "source", "lang", "key",
        F.size(statistics.words(F.col("text"))).cast("long").alias("words"), F.size(statistics.words(F.col("once"))).cast("long").alias("words_once"),
        signs("text").alias("signs"), signs("once").alias("signs_once"),
    )
    counted = written(counted, "token-counts")
    held = TokenTotals(spark, f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}")

    def change(rows: DataFrame, version: str, count: str | None) -> DataFrame:
        n = F.col(count) if count else F.lit(0).cast("long")
        return rows.select("doc_id", "source", "lang", F.lit(version).alias("version"), n.alias("n_tokens"), F.lit(count is None).alias("deleted"))

    held.commit(1, change(counted, WORDS, "words"))
    held.commit(2, change(counted, SIGNS, "signs"))
    held.commit(3, change(counted, WORDS, "words_once").unionByName(change(counted, SIGNS, "signs_once")))
    held.commit(2, change(counted, SIGNS, "signs"))
    first = written(counted.groupBy("key").agg(F.min("doc_id").alias("first")), "first-copies")
    copies = counted.join(first, "key").filter(F.col("doc_id") > F.col("first"))
    held.commit(4, change(copies, WORDS, None).unionByName(change(copies, SIGNS, None)))
    return held.totals()


CORPUS_SQL = r"""
with d as (
  select doc_id, source, lang, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first,
    array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) as once from documents),
k as (
  select source, lang, 'words-1' as version, len(regexp_extract_all(once, '[^\x20\x09-\x0D]+')) as n from d where doc_id = first
  union all
  select source, lang, 'signs-1', len(regexp_extract_all(once, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) from d where doc_id = first)
select source, lang, version, count(*) as n_docs, cast(sum(n) as bigint) as n_tokens from k group by source, lang, version
"""
