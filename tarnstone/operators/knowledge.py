"""A stored search index over files: fragments, posting blocks and a manifest, refreshed file by file.

Each refresh writes a generation of its own: files (path, modified, length), docs (fragments with their token count and their
terms), terms (df), stats (n, avg_dl of each category) and blocks. A one-row manifest with version, set-up and fingerprint is written
last, so that readers see whole generations only. Categories may have tokenisers of their own; all share one table of
postings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tarnstone.functions.segment import Segmenter, slices
from tarnstone.functions.text import tokenize_en
from tarnstone.operators.search import K1, B, counted, idf_of, laid_out, top, unique
from tarnstone.sources.files import delete, differences, exists, stored

#: Of the layout of the tables; an index of another version is built anew.
VERSION = 3
#: Postings of a block at most.
BLOCK = 1024
#: Documents of a range of ids, about, and postings of one term that travel together at most.
RANGE, RUN = 65536, 64
FRAGMENT = ["doc_id", "file", "category", "line_start", "line_end", "content"]
MANIFEST = "epoch long, version int, setup string, fingerprint string, generation string"
BLOCKS = "category string, term string, first long, last long, n int, impact double, docs array<long>, tfs array<int>, dls array<int>"
RUNS = "category string, term string, range int, docs array<long>, tfs array<int>, dls array<int>, avg_dl double"


@dataclass(frozen=True)
class Tokenizer:
    """name: changes with whatever changes its tokens; tokens: of a column of texts that are not null."""

    name: str
    tokens: Callable[[Column], Column]


ENGLISH = Tokenizer("english-1", tokenize_en)


def chinese(spark: SparkSession, segmenter: Segmenter, stop: frozenset[str] = frozenset()) -> Tokenizer:
    """The segmenter's search tokens without stop words, in Arrow batches; its dictionary is sent to each worker once."""
    shared = spark.sparkContext.broadcast((segmenter, stop))

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        own, without = shared.value
        parts = [pa.array([own.tokens(t, without) for t in some.to_pylist()], pa.list_(pa.string())) for some in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    said = hashlib.sha256(repr((segmenter.described(), sorted(stop))).encode()).hexdigest()
    return Tokenizer(f"chinese-1-{said[:16]}", cut)


def _cut(category: pa.Array, term: pa.Array, doc: np.ndarray, tf: np.ndarray, dl: np.ndarray, impact: np.ndarray, block: int) -> pa.RecordBatch:
    """BLOCKS rows of postings (one at least) that are in the order of category, term and document."""
    new = np.append(True, _changes(category) | _changes(term))
    run = np.flatnonzero(new)
    inside = np.arange(len(doc)) - np.repeat(run, np.diff(np.append(run, len(doc))))
    begin = np.flatnonzero(inside % block == 0)
    ends = np.append(begin[1:], len(doc))
    offsets = pa.array(np.append(begin, len(doc)), pa.int32())
    at = pa.array(begin)
    columns = [
        category.take(at), term.take(at), pa.array(doc[begin]), pa.array(doc[ends - 1]), pa.array((ends - begin).astype(np.int32)), pa.array(np.maximum.reduceat(impact, begin)),
        *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc, tf.astype(np.int32), dl.astype(np.int32))],
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCKS.split(", ")])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before, from the second row on; a null counts as empty."""
    column = column.fill_null("")
    return pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).to_numpy(zero_copy_only=False)


def document_blocks(docs: DataFrame, bounds: list[int], block: int = BLOCK) -> DataFrame:
    """The blocks of posting_blocks, from documents with their terms: category, doc_id, dl, terms, sizes, tfs (see counted), avg_dl.

    bounds: ids, ascending, that cut the documents into ranges. A task packs the postings of its documents into runs of one
    term and range, so that a term travels once for many documents; runs are ranged by term and range together, and those
    of one term and range, which are put in order in one task, hold no more documents than the range.
    """
    names = [x.split()[0] for x in RUNS.split(", ")]
    split = np.array(bounds, np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "terms", 1 << 24):
                some = some.take(pc.sort_indices(some["doc_id"]))
                row, terms, tf = laid_out(some)
                if len(row) == 0:
                    continue
                coded, category = terms.dictionary_encode(), some["category"].dictionary_encode(null_encoding="encode")
                doc = some["doc_id"].to_numpy()
                key = (category.indices.to_numpy()[row].astype(np.int64) * len(coded.dictionary) + coded.indices.to_numpy()) * (len(split) + 1) + np.searchsorted(split, doc, "right")[row]
                by = np.argsort(key, kind="stable")
                key, row = key[by], row[by]
                group = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                inside = np.arange(len(key)) - np.repeat(group, np.diff(np.append(group, len(key))))
                begin = np.flatnonzero(inside % RUN == 0)
                offsets, first = pa.array(np.append(begin, len(key)), pa.int32()), pa.array(row[begin])
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc[row], tf[by], some["dl"].to_numpy()[row])]
                term = coded.dictionary.take(coded.indices.take(pa.array(by[begin])))
                yield pa.RecordBatch.from_arrays([some["category"].take(first), term, pa.array((key[begin] % (len(split) + 1)).astype(np.int32)), *lists, some["avg_dl"].take(first)], names)

    def merged(runs: pa.Table) -> pa.RecordBatch:
        runs = runs.combine_chunks().to_batches()[0]
        group = np.cumsum(np.append(False, _changes(runs["category"]) | _changes(runs["term"])))
        run = pc.list_parent_indices(runs["docs"]).to_numpy()
        doc, tf, dl = (runs[x].flatten().to_numpy() for x in ("docs", "tfs", "dls"))
        by = np.lexsort((doc, group[run]))
        doc, tf, dl, run = doc[by], tf[by], dl[by], run[by]
        avg = np.maximum(runs["avg_dl"].to_numpy()[run], 1e-9)
        return _cut(runs["category"].take(pa.array(run)), runs["term"].take(pa.array(run)), doc, tf, dl, tf / (tf + K1 * (1 - B + B * dl / avg)), block)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            one = rows.combine_chunks().to_batches()[0]
            new = _changes(one["category"]) | _changes(one["term"]) | pc.not_equal(one["range"].slice(1), one["range"].slice(0, len(one) - 1)).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if last:
                yield merged(rows.slice(0, last))
            kept = rows.slice(last)
        if kept is not None:
            yield merged(kept)

    by = ["category", "term", "range"]
    runs = docs.select("category", "doc_id", "dl", "terms", "sizes", "tfs", "avg_dl").mapInArrow(pack, RUNS)
    return runs.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(merge, BLOCKS)


def posting_blocks(postings: DataFrame, block: int = BLOCK) -> DataFrame:
    """category, term, first, last, n, impact, docs, tfs, dls: a term's postings in document order, in blocks of at most `block`.

    postings: category, term, doc_id, tf, dl, impact. Rows are ranged by term and document together, so that a common
    term spreads over tasks, and no list of a term is ever gathered.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _cut(*batch.columns[:2], *[x.to_numpy() for x in batch.columns[2:]], block)

    by = ["category", "term", "doc_id"]
    return postings.select(*by, "tf", "dl", "impact").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, BLOCKS)


def impact(avg_dl: Column) -> Column:
    """A posting's share of its term's weight: BM25 without the idf and the constant factor, below 1."""
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(avg_dl, F.lit(1e-9))))


@dataclass
class Knowledge:
    """The index in a folder that all machines see. tokenizers: by category; other: of all other categories."""

    spark: SparkSession
    folder: str
    tokenizers: dict[str, Tokenizer] = field(default_factory=dict)
    other: Tokenizer = ENGLISH
    block: int = BLOCK

    def _setup(self) -> str:
        names = sorted((c, t.name) for c, t in self.tokenizers.items())
        return hashlib.sha256(repr((names, self.other.name, self.block)).encode()).hexdigest()[:16]

    def manifest(self) -> Row | None:
        """The newest whole manifest, of any version; a row that cannot be read counts as none."""
        if not exists(self.spark, f"{self.folder}/manifest"):
            return None
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").filter("epoch IS NOT NULL AND generation IS NOT NULL")
        return rows.orderBy(F.desc("epoch"), F.desc("generation")).first()

    def usable(self) -> Row | None:
        """The manifest, if version and set-up are this one's and its tables are there."""
        found = self.manifest()
        right = found is not None and found.version == VERSION and found.setup == self._setup()
        return found if right and exists(self.spark, f"{self.folder}/{found.generation}/files/_SUCCESS") else None

    def table(self, name: str) -> DataFrame:
        found = self.usable()
        if found is None:
            raise ValueError(f"no index of this version and set-up in {self.folder}")
        return self._read(found.generation, name)

    def _read(self, generation: str, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{generation}/{name}")
        return rows.drop("terms", "sizes", "tfs") if name == "docs" else rows

    def refresh(self, files: DataFrame, fragments: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Brings the index up to the files and tells how many were added, changed and gone; without any, nothing is written.

        files: path, modified, length. fragments: from a table of paths to FRAGMENT rows, read for added and changed files
        only, and cut into tokens once. Of all other files, fragments and their terms are carried over. An index of another
        version or set-up is built anew. Null contents have no tokens; an empty table of files gives an empty index.
        """
        files = stored(files.select("path", "modified", "length"), "index-files")
        stamp = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "modified", "length").cast("decimal(38,0)")).alias("h")).first()
        fingerprint, found, now = f"{stamp.n}-{stamp.h or 0}", self.manifest(), self.usable()
        if now is not None and now.fingerprint == fingerprint:
            return {"added": 0, "changed": 0, "gone": 0}
        old = self.table("files") if now is not None else files.limit(0)
        moved = stored(differences(old, files), "index-moved")
        docs = self._counted(fragments(moved.filter("kind <> 'gone'").select("path")).select(*FRAGMENT))
        if now is not None:
            same = self.spark.read.parquet(f"{self.folder}/{now.generation}/docs")
            docs = docs.unionByName(same.join(moved.select(F.col("path").alias("file")), "file", "left_anti"))
        generation = f"generation-{uuid.uuid4().hex}"
        path = f"{self.folder}/{generation}"
        docs.write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl")).write.parquet(f"{path}/stats")
        stats = self._read(generation, "stats").select(F.col("category").alias("of"), "avg_dl")
        known = docs.join(F.broadcast(stats), F.col("category").eqNullSafe(F.col("of")))
        document_blocks(known, self._bounds(docs), self.block).write.parquet(f"{path}/blocks")
        terms = self._read(generation, "blocks").groupBy("category", "term").agg(F.sum("n").alias("df"))
        terms.repartitionByRange("category", "term").sortWithinPartitions("category", "term").write.parquet(f"{path}/terms")
        files.write.parquet(f"{path}/files")
        row = (found.epoch + 1 if found else 1, VERSION, self._setup(), fingerprint, generation)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        counts = {r.kind: r.n for r in moved.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {kind: counts.get(kind, 0) for kind in ("added", "changed", "gone")}

    def _counted(self, fresh: DataFrame) -> DataFrame:
        """The fragments with dl, terms, tfs, in one reading: each tokeniser gets the texts of its categories, and empty ones else."""
        text, none = F.coalesce("content", F.lit("")), F.lit("")
        mine = {one: F.coalesce(F.col("category").isin(*[c for c, t in self.tokenizers.items() if t == one]), F.lit(False)) for one in set(self.tokenizers.values())}
        rest = F.coalesce(~F.col("category").isin(*self.tokenizers), F.lit(True))
        said = counted(self.other.tokens(F.when(rest, text).otherwise(none)))
        for one, here in mine.items():
            said = F.when(here, counted(one.tokens(F.when(here, text).otherwise(none)))).otherwise(said)
        return fresh.withColumn("said", said).select(*FRAGMENT, "said.*")

    def _bounds(self, docs: DataFrame) -> list[int]:
        """Ids that cut the documents into ranges of about RANGE each."""
        parts = -(-docs.count() // RANGE)
        if parts < 2:
            return []
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10000, 10 * parts))).first()[0]
        return sorted(set(cuts))

    def clear(self) -> None:
        """Deletes the generations that the newest manifest does not name; readers of those must have ended."""
        found = self.manifest()
        rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest").select("generation").distinct().collect() if found else []
        for r in rows:
            if r.generation and r.generation != found.generation:
                delete(self.spark, f"{self.folder}/{r.generation}")

    # ------------------------------------------------------------ search

    def _needed(self, category: str, tokens: list[str], top_k: int) -> tuple[Column, list[Row], Row | None]:
        """(which blocks may hold one of the best, idf of the query's terms, the category's statistics).

        The k-th best block of a term has a posting of that impact, and blocks of a term hold different documents: k
        documents score at least that. A block goes if its best posting, with all other terms at their best, stays below.
        Only heads of blocks are read for this; the driver gets two numbers for each term of the query.
        """
        terms = unique(tokens)
        stats = self.table("stats").filter(F.col("category") == category).first()
        here = (F.col("category") == category) & F.col("term").isin(terms)
        if stats is None:
            return F.lit(False), [], None
        idfs = self.table("terms").filter(here).select("term", idf_of(F.lit(stats.n), F.col("df")).alias("idf")).collect()
        if top_k <= 0:
            return here, idfs, stats
        heads = self.table("blocks").filter(here).select("term", "impact").withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"))))
        best = {r.term: r for r in heads.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("rank") == top_k, F.col("impact"))).alias("kth")).collect()}
        most = {r.term: r.idf * (K1 + 1) * best[r.term].most for r in idfs}
        least = max((r.idf * (K1 + 1) * best[r.term].kth for r in idfs if best[r.term].kth is not None), default=0.0)
        keep = F.lit(False)
        for r in idfs:
            others = sum(most.values()) - most[r.term]
            keep = keep | ((F.col("term") == r.term) & (F.col("impact") >= (least - others) / (r.idf * (K1 + 1)) * (1 - 1e-9) - 1e-12))
        return (F.col("category") == category) & keep, idfs, stats

    def blocks_read(self, category: str, tokens: list[str], top_k: int = -1) -> DataFrame:
        """The blocks that a search reads; the conditions on term and impact reach the scan."""
        return self.table("blocks").filter(self._needed(category, tokens, top_k)[0])

    def search(self, category: str, tokens: list[str], top_k: int = -1) -> DataFrame:
        """doc_id, score of a category's fragments by BM25: the best top_k in order, ties by doc_id; with top_k <= 0 all hits, in none."""
        keep, idfs, stats = self._needed(category, tokens, top_k)
        blocks = self.table("blocks").filter(keep)
        idf = F.lit(0.0)
        for r in idfs:
            idf = F.when(F.col("term") == r.term, F.lit(r.idf)).otherwise(idf)
        hits = blocks.select("term", F.inline(F.arrays_zip("docs", "tfs", "dls"))).toDF("term", "doc_id", "tf", "dl")
        weight = idf * (K1 + 1) * impact(F.lit(stats.avg_dl if stats else 1.0))
        return top(hits.select("doc_id", weight.alias("w")).groupBy("doc_id").agg(F.sum("w").alias("score")), top_k)
