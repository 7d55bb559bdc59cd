"""Near duplicates by an exact n-gram Jaccard join: a grouped prefix join.

1. Shingles are counted over all documents. Each task packs the shingles of a run of documents into one binary row
   a bucket (seven bytes a shingle, and the steps of the documents' numbers, compressed); the reducers count, and send back only
   the shingles that occur twice or more.
2. In the order from rare to frequent, two documents with similarity t share a shingle among the first
   n - ceil(t n) + 1 of each. Shingles that occur once come first and match nothing, so a document whose prefix holds no
   others leaves here; most do.
3. Documents with identical sets form a class, classes with identical prefix and size a group. Groups that share a prefix
   shingle meet at the least of them (a star).
4. Pairs of groups are filtered by what sizes and prefixes tell: what two sets can have in common is at most what their
   prefixes have, and the rest of the larger one. Only groups that are left in some pair are expanded into their classes, whose
   sets are then fetched and verified. A task returns a spanning forest of the links it has verified, not all pairs; components
   are joined by alternating stars.
5. A star of more than ``block`` classes is first verified against its centre alone, salted, in linear work: what links to the centre
   need not meet what links to it as well, so only the groups that don't are dealt against the whole star, block by block.

No partner or candidate is capped. A word is known by 64 bits, a shingle by 56 bits of its hash and its bucket (all 64 from 256 buckets on), a set and
a prefix by 128. Nothing is compared with the text: with s different shingles in all, some two are taken for one with a probability of about
s * s / 2**65 (3e-4 for 10**8, and from 10**10 on some are); such a pair changes a result only where it is what lifts two documents over the similarity.

Defined results: null text and text without words have no shingles and no links; rows that repeat an id are one node with
the links of each, and each comes back; rows with a null id come back with a null component; empty tables give empty
results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import U, chained, lower_ascii, mix, partitions, run_hash, slices, text_chunks, word_hash, word_spans
from tidewire.llm.chunks import BucketedTable
from tidewire.llm.repeats import press, unpress
from tidewire.operators.graph import components
from tidewire.session import cut

WORDS, SIMILARITY, BLOCK, TOKEN_BYTES = 5, 75, 512, 7
PACKED = "bucket int, chunk long, token binary, doc binary, ids binary, sizes binary"
COUNTED = "chunk long, bucket int, token binary, count binary, doc binary, ids binary, sizes binary"
SETS = "doc_id long, n_shingles long, sig binary, form binary, prefix binary, tokens binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs, sorted and distinct; a text with fewer words is one shingle."""
    data = lower_ascii(data)
    start, end, first = word_spans(data, offsets)
    words = word_hash(data, start, end)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(words))
    whole = at + width <= first[1:][text] if len(words) else np.empty(0, bool)
    runs = run_hash(words, width)
    owner, shingle = text[whole], runs[at[whole]] if len(runs) else np.empty(0, U)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = mix(words[first[few]] + count[few].astype(U))
        for k in range(1, width - 1):
            more = np.flatnonzero(count[few] > k)
            short[more] = chained(short[more], words[first[few[more]] + k])
        owner, shingle = np.concatenate((owner, few)), np.concatenate((shingle, short))
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[keep], shingle[keep]


def steps(docs: np.ndarray) -> bytes:
    """Ascending numbers below 60,000 as their steps, compressed."""
    return press(np.diff(docs, prepend=0).astype("<u2").tobytes())


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpress(raw), "<u2"), dtype=np.uint16)


def _packer(width: int, buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column("doc_id")
            null = np.array([not x.is_valid for x in ids])
            ids = ids.fill_null(0).to_numpy()
            for lo, hi, data, offsets in text_chunks(b.column("text")):
                owner, shingle = shingle_sets(data, offsets, width)
                sizes = np.bincount(owner, minlength=hi - lo).astype("<i8")
                sizes[null[lo:hi]] = -1 - sizes[null[lo:hi]]
                bucket = (shingle % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                short = (shingle[order] // U(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                doc = owner[order]
                full = np.flatnonzero(np.diff(bounds))
                rows = len(full) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(full, chunk % buckets), pa.int32()),
                        pa.array(np.full(rows, chunk), pa.int64()),
                        pa.array([np.ascontiguousarray(short[bounds[k] : bounds[k + 1]]).tobytes() for k in full] + [None], pa.binary()),
                        pa.array([steps(doc[bounds[k] : bounds[k + 1]]) for k in full] + [None], pa.binary()),
                        pa.array([None] * len(full) + [ids[lo:hi].astype("<i8").tobytes()], pa.binary()),
                        pa.array([None] * len(full) + [sizes.tobytes()], pa.binary()),
                    ],
                    names=["bucket", "chunk", "token", "doc", "ids", "sizes"],
                )
                chunk += 1

    return pack


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """The shingles of a bucket that occur twice or more, by chunk, and the chunks' own rows as they are."""
    info = rows[rows["ids"].notna()]
    out = pd.DataFrame({"chunk": info["chunk"], "bucket": info["bucket"], "token": None, "count": None, "doc": None, "ids": info["ids"], "sizes": info["sizes"]})
    rows = rows[rows["token"].notna()]
    if len(rows):
        docs = [unsteps(x) for x in rows["doc"]]
        lens = np.array([len(x) for x in docs])
        token = np.zeros((lens.sum(), 8), np.uint8)
        token[:, :TOKEN_BYTES] = np.frombuffer(b"".join(rows["token"]), np.uint8).reshape(-1, TOKEN_BYTES)
        short, token = token[:, :TOKEN_BYTES], token.view("<u8").ravel()
        order = np.argsort(token)
        s = token[order]
        begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.empty(len(s), np.uint32)
        count[order] = np.repeat(np.diff(np.append(begin, len(s))), np.diff(np.append(begin, len(s))))
        keep = count > 1
        bounds = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, np.cumsum(lens) - lens))))
        doc, count = np.concatenate(docs)[keep].astype(np.int64), count[keep].astype("<u4")
        cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
        got = pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "token": slices(np.ascontiguousarray(short[keep]), bounds), "count": [press(count[a:b].tobytes()) for a, b in cuts], "doc": [steps(doc[a:b]) for a, b in cuts], "ids": None, "sizes": None})
        out = pd.concat([out, got[np.diff(bounds) > 0]])
    return out


def prefix_length(n: np.ndarray, similarity: int) -> np.ndarray:
    return n - (n * similarity + 99) // 100 + 1


def _assembler(similarity: int, buckets: int):
    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        """Every document of a chunk; those with a repeated shingle in the prefix with their repeated shingles, rare ones first."""
        info = rows[rows["ids"].notna()].iloc[0]
        ids, sizes = np.frombuffer(info["ids"], "<i8"), np.frombuffer(info["sizes"], "<i8")
        null, n = sizes < 0, np.where(sizes < 0, -1 - sizes, sizes)
        rows = rows[rows["token"].notna()]
        docs = [unsteps(x) for x in rows["doc"]]
        doc = np.concatenate(docs) if docs else np.empty(0, np.uint16)
        token = np.zeros((len(doc), 8), np.uint8)
        token[:, :TOKEN_BYTES] = np.frombuffer(b"".join(rows["token"]), np.uint8).reshape(-1, TOKEN_BYTES)
        token = token.view("<u8").ravel() * U(buckets) + np.repeat(rows["bucket"].to_numpy(), [len(x) for x in docs]).astype(U)
        count = np.frombuffer(b"".join(unpress(x) for x in rows["count"]), "<u4")
        order = np.lexsort((token, count, doc))
        token, doc = token[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(n) + 1))
        repeated = np.diff(bounds)
        prefix = np.where(null | (n == 0), 0, np.minimum(prefix_length(n, similarity) - (n - repeated), repeated))
        out: dict[str, list] = {"sig": [], "form": [], "prefix": [], "tokens": []}
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if prefix[k] <= 0:
                for v in out.values():
                    v.append(None)
                continue
            own = token[a:b]
            alone = b"" if repeated[k] == n[k] else b"%d %d" % (ids[k], n[k])  # with a shingle of its own no other set is the same
            out["sig"].append(hashlib.blake2b(np.sort(own).tobytes() + alone, digest_size=16).digest())
            first = own[: prefix[k]].tobytes()
            out["form"].append(hashlib.blake2b(b"%d " % n[k] + first, digest_size=16).digest())
            out["prefix"].append(first)
            out["tokens"].append(own.tobytes())
        return pd.DataFrame({"doc_id": pd.Series(np.where(null, 0, ids)).astype("Int64").mask(null), "n_shingles": n, **out})

    return assemble


def shared_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets have in common, a strip of tokens at a time."""
    size = len(sets)
    doc = np.repeat(np.arange(size), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = times[column] > 1
    doc, column = doc[both], np.searchsorted(np.flatnonzero(times > 1), column[both])
    shared = np.zeros((size, size), np.float32)
    step, width = 4096, int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        x = np.zeros((size, min(step, width - lo)), np.float32)
        x[doc[a:b], column[a:b] - lo] = 1
        shared += x @ x.T
    return shared.astype(np.int64)


def _may_link(n: np.ndarray, asks: np.ndarray, common: np.ndarray, similarity: int) -> np.ndarray:
    """Which pairs, of which one asks, can reach the similarity if they have at most ``common`` tokens in common."""
    pairs = asks[:, None] | asks[None, :]
    pairs &= 100 * np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])
    pairs &= 100 * common >= similarity * (n[:, None] + n[None, :] - common)
    return pairs


def _cells(rows: pd.DataFrame, names: list[str], name: str) -> Iterator[pd.DataFrame]:
    """The rows of each cell, once each; one that both asks and is asked asks."""
    rows = rows.sort_values([*names, "asks"], ascending=[True] * len(names) + [False]).drop_duplicates([*names, name])
    keys = rows[names].to_numpy()
    begin = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    for lo, hi in zip(begin, np.append(begin[1:], len(rows)), strict=True):
        yield rows.iloc[lo:hi]


def _filter(similarity: int):
    def keep(bucket: pd.DataFrame) -> pd.DataFrame:
        """The groups of each cell that are left in some pair, by size and prefix."""
        out = []
        for rows in _cells(bucket, ["star", "i", "j"], "grp"):
            n, asks = rows["n"].to_numpy(), rows["asks"].to_numpy()
            common = shared_tokens([np.frombuffer(x, "<u8") for x in rows["prefix"]])
            rest = n - prefix_length(n, similarity)
            pairs = _may_link(n, asks, np.where(common > 0, common + np.maximum(rest[:, None], rest[None, :]), 0), similarity)
            pairs[np.diag_indices(len(n))] = asks & (rows["classes"].to_numpy() > 1)
            out.append(rows[["star", "i", "j", "grp", "asks"]][pairs.any(1)])
        return pd.concat(out)

    return keep


def _verifier(similarity: int):
    def verify(bucket: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links between the classes of each cell."""
        pairs = []
        for rows in _cells(bucket, ["star", "i", "j", "p", "q"], "member"):
            n, node, asks = rows["n"].to_numpy(), rows["node"].to_numpy(), rows["asks"].to_numpy()
            link = _may_link(n, asks, shared_tokens([np.frombuffer(x, "<u8") for x in rows["tokens"]]), similarity)
            np.fill_diagonal(link, False)
            seen = np.zeros(len(n), bool)
            for root in np.flatnonzero(link.any(1)):
                if seen[root]:
                    continue
                seen[root] = True
                front = np.array([root])
                while len(front):
                    front = np.flatnonzero(link[front].any(0) & ~seen)
                    seen[front] = True
                    pairs += [(node[root], node[x]) for x in front if node[x] != node[root]]
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    return verify


def _with_centre(similarity: int):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """The classes of a part of a star that link to its centre, with their groups."""
        centre = rows[rows["member"] == rows["star"]].iloc[0]
        own = np.sort(np.frombuffer(centre["tokens"], "<u8"))
        sets = [np.frombuffer(x, "<u8") for x in rows["tokens"]]
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1])))
        n = rows["n"].to_numpy()
        linked = 100 * common >= similarity * (n + centre["n"] - common)
        got = rows[linked].drop_duplicates("member")
        return pd.DataFrame({"star": got["star"], "grp": got["grp"], "member": got["member"], "a": centre["node"], "b": got["node"]})

    return verify


def sets(documents: DataFrame, width: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id and n_shingles of every row; for candidates the digest, prefix and whole of their repeated shingles too."""
    buckets = min(2 * partitions(documents.sparkSession), 60_000)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(_packer(width, buckets), PACKED)
    counted = packed.groupBy("bucket").applyInPandas(_count, COUNTED)
    return cut(counted.groupBy("chunk").applyInPandas(_assembler(similarity, buckets), SETS))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the same set as one, as far as they come together: copies fold up before the shuffle."""
    for b in batches:
        ids, sigs = b.column("node").to_pylist(), b.column("sig").to_pylist()
        first: dict[bytes, list] = {}
        for k, (i, sig) in enumerate(zip(ids, sigs, strict=True)):
            own = first.setdefault(sig, [k, i, 0])
            own[1], own[2] = min(own[1], i), own[2] + 1
        rows = b.take(pa.array([k for k, _, _ in first.values()], pa.int64()))
        columns = dict(zip(rows.schema.names, rows.columns, strict=True)) | {"node": pa.array([i for _, i, _ in first.values()], pa.int64()), "copies": pa.array([n for _, _, n in first.values()], pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def links(all_sets: DataFrame, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of doc_ids that span the same components as all links do.

    The classes are a table in the shared folder, dealt by class, so that their sets are not shuffled again for each join; it is dropped at the end.
    """
    spark = all_sets.sparkSession
    table = BucketedTable(spark, "classes", "member")
    found = all_sets.filter(F.col("sig").isNotNull()).select(F.xxhash64("sig").alias("member"), "sig", F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "form", "prefix", "tokens", F.lit(1).cast("long").alias("copies"))
    folded = found.mapInArrow(_fold, found.schema).repartition(table.buckets, "member")
    one = [F.first(c).alias(c) for c in ("n", "form", "prefix", "tokens")]
    try:
        table.write(folded.groupBy("member", "sig").agg(F.min("node").alias("node"), F.sum("copies").alias("copies"), *one))
        return cut(_links(all_sets, table.read(), similarity, block))
    finally:
        table.drop()


def _links(all_sets: DataFrame, classes: DataFrame, similarity: int, block: int) -> DataFrame:
    tasks = 4 * partitions(all_sets.sparkSession)
    several_rows = classes.filter("copies > 1").select("sig", "node")
    copies = all_sets.filter(F.col("sig").isNotNull()).select("doc_id", "sig").join(several_rows, "sig").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    sets_of = classes.select("member", "node", "n", "tokens")
    groups = cut(classes.groupBy("form").agg(F.min("member").alias("grp"), F.count("*").alias("classes"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    in_group = cut(classes.select("form", "member").join(groups.select("form", "grp"), "form").select("grp", "member"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column("prefix")]
            times = [len(x) for x in prefix]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefix or [np.empty(0, np.int64)])), pa.array(np.repeat(b.column("grp").to_numpy(), times))], names=["token", "grp"])

    postings = groups.select("grp", "prefix").mapInArrow(explode, "token long, grp long")
    # a frequent token's postings are split by skew handling, which needs a shuffle right below both sides of the join
    lead = postings.groupBy("token").agg(F.min("grp").alias("star"), F.max("grp").alias("most")).filter("star <> most").select("token", "star").repartition("token")
    several = groups.filter("classes > 1").select(F.col("grp").alias("star"), "grp")  # a group of several classes meets itself
    stars = cut(postings.join(lead, "token").select("star", "grp").unionByName(several).distinct())
    sizes = stars.join(groups.select("grp", "classes"), "grp").groupBy("star").agg(F.ceil(F.sum("classes") / block).alias("parts"))

    large = cut(sizes.filter("parts > 1"))
    salted = stars.join(large, "star").join(in_group, "grp").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    centres = large.select("star", F.col("star").alias("grp"), F.col("star").alias("member"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = salted.select("star", "grp", "member", "part").unionByName(centres).join(sets_of, "member")
    centred = cut(near.repartition(tasks, "star", "part").groupBy("star", "part").applyInPandas(_with_centre(similarity), "star long, grp long, member long, a long, b long"))
    linked = centred.select("star", "grp", "member").distinct().groupBy("star", "grp").agg(F.count("*").alias("linked"))
    settled = linked.join(groups.select("grp", "classes"), "grp").filter("linked = classes").select("star", "grp", F.lit(False).alias("open"))

    every = stars.join(settled, ["star", "grp"], "left").select("star", "grp", F.coalesce("open", F.lit(True)).alias("asks"))
    blocks = every.groupBy("star").agg(F.ceil(F.count("*") / block).cast("int").alias("of_all"), F.ceil(F.count_if("asks") / block).cast("int").alias("of_asking")).filter("of_asking > 0")
    dealt = every.join(blocks, "star")
    place = lambda n: F.pmod(F.xxhash64("grp"), F.col(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bucket = lambda *names: F.pmod(F.xxhash64(*names), F.lit(tasks)).alias("bucket")  # noqa: E731  (many cells are small, so a call takes a bucket of them)
    asking = dealt.filter("asks").select("star", "grp", "asks", place("of_asking").alias("i"), to_all("of_all").alias("j"))
    alone = (F.col("of_all") == 1) & F.col("asks")  # in a star of one block a group that asks need not come twice
    asked = dealt.filter(~alone).select("star", "grp", F.lit(False).alias("asks"), to_all("of_asking").alias("i"), place("of_all").alias("j"))
    cells = asked.unionByName(asking).join(groups.select("grp", "n", "prefix", "classes"), "grp").select("*", bucket("star", "i", "j"))
    left = cells.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_filter(similarity), "star long, i int, j int, grp long, asks boolean")
    expanded = cut(left.join(in_group, "grp").select("star", "i", "j", "member", "asks").distinct())
    parts = expanded.groupBy("star", "i", "j").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts"))
    met = expanded.join(parts, ["star", "i", "j"]).withColumn("own", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).withColumn("other", to_all("parts"))
    met = met.select("star", "i", "j", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "member", "asks").join(sets_of, "member")
    edges = met.select("*", bucket("star", "i", "j", "p", "q")).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(_verifier(similarity), "a long, b long").distinct()
    return edges.unionByName(centred.filter("a <> b").select("a", "b")).unionByName(copies)


def near_duplicates(documents: DataFrame, width: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links, of every row."""
    all_sets = sets(documents, width, similarity)
    found = components(links(all_sets, similarity))
    rows = all_sets.select("doc_id", "n_shingles")
    return rows.join(found, rows["doc_id"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(documents: DataFrame, width: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that a smaller doc_id reaches by links, with all their columns. Of rows that repeat an id and have
    words the one with the least text stays (of equal texts, one); rows without words or with a null id stay."""
    all_sets = sets(documents, width, similarity)
    # names that no column of the documents has
    judged_name, rank_name, id_name = ("_".join(documents.columns) + x for x in ("_stay", "_rank", "_id"))
    gone = components(links(all_sets, similarity)).filter("component <> node").select(F.col("node").alias(id_name), F.lit(0).alias(judged_name))
    twice = all_sets.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(F.col("doc_id").alias(id_name)).agg(F.count("*").alias("n")).filter("n > 1").join(gone, id_name, "left_anti")
    told = cut(gone.unionByName(twice.select(id_name, F.lit(1).alias(judged_name))))
    judged = documents.join(told, F.col("doc_id").cast("long") == F.col(id_name), "left")
    once = judged.filter(F.col(judged_name) == 1)
    rank = once.withColumn(rank_name, F.row_number().over(Window.partitionBy(id_name).orderBy(F.coalesce(F.trim("text"), F.lit("")) == "", "text")))
    back = [F.col(f"`{c}`") for c in documents.columns]
    return judged.filter(F.col(judged_name).isNull()).select(*back).unionByName(rank.filter(F.col(rank_name) == 1).select(*back))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""
