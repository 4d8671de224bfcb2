"""Alignment of two tokenizers on the same texts, by elementary intervals of their byte offsets.

The ends of both tokenizations, merged, cut a text into elementary intervals. Each lies in one token of
either side, so each is one overlap of two tokens; an end that both share closes a group. How often two
tokens overlap is counted over the whole corpus and read back for every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from codexframe.llm.common import materialize, slices, worker_cache
from codexframe.llm.tokencount import byte_chars, load_tokenizer, public_file

#: Overlaps and documents of a block. A block tells each pair of tokens once, whatever its number of overlaps.
BLOCK_LINKS, BLOCK_DOCUMENTS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Alignment:
    """Two tokenizations of one text; ``ends`` are its elementary intervals' ends in bytes."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray
    own_a: np.ndarray  # the token of A, by place, that holds each interval
    own_b: np.ndarray
    group_a: np.ndarray  # the group of each token of A
    group_b: np.ndarray
    n_groups: int

    @property
    def pairs(self) -> np.ndarray:
        """Both tokens' ids of each overlap as one number: A's above 32 bits of B's."""
        return (self.a[self.own_a] << 32) | self.b[self.own_b]

    @property
    def group_products(self) -> int:
        """Pairs of tokens that share a group."""
        return int(np.bincount(self.group_a, minlength=self.n_groups) @ np.bincount(self.group_b, minlength=self.n_groups))


def align_ids(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Alignment:
    """Align ids ``a`` and ``b`` whose tokens have ``size_a`` and ``size_b`` bytes, the same in all."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
    return Alignment(a, b, ends, own_a, own_b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), len(shared))


def _rank_engine(path: str):
    """The merge engine of the rank file that lies beside a vocabulary, if there is one: for texts in Latin-1, where
    both libraries cut words alike, it gives the same ids several times faster."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    ranks = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


class Pair:
    """Both tokenizers of a task, with the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.first, self.ranked = load_tokenizer(path_a), _rank_engine(path_a)
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, number in vocab.items():
            self.bytes_a[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode("utf-8")
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for number in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(number)
            byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8"))
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = np.array([f"{i}{end}" for i in range(most) for end in ",|;"], object)

    def ids_a(self, text: str) -> list[int]:
        """A's ids of a text in which the strings of special tokens are ordinary text."""
        if self.ranked is not None:
            try:
                text.encode("latin-1")
                return self.ranked.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        self.first.encode_special_tokens = True
        ids = self.first.encode(text, add_special_tokens=False).ids
        self.first.encode_special_tokens = False
        return ids

    def align(self, text: str | None) -> Alignment | None:
        """The alignment of one text; none for a null or empty text, or if a tokenizer doesn't give its bytes back."""
        if not text:
            return None
        a = self.ids_a(f" {text}")
        whole = f" {text}".encode("utf-8")
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole:
            return None
        b = self.second.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return align_ids(a, b, self.size_a[a], self.size_b[b])

    def groups_text(self, found: Alignment) -> str:
        """All groups in order as ``a1,a2|b1;a3|b2,b3``."""
        mine, other = found.group_a, found.group_b
        out = np.empty(len(mine) + len(other), np.int64)
        # a token stands after those of its side and the other side's tokens of earlier groups, of B also of its own
        last_a, last_b = np.append(mine[1:] != mine[:-1], True), np.append(other[1:] != other[:-1], True)
        out[np.arange(len(mine)) + np.searchsorted(other, mine, "left")] = found.a * 3 + last_a
        out[np.arange(len(other)) + np.searchsorted(mine, other, "right")] = found.b * 3 + 2 * last_b
        return "".join(self.written[out].tolist())[:-1]


def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    """The pair of this process."""
    held = worker_cache()
    if ("pair", path_a, path_b) not in held:
        held["pair", path_a, path_b] = Pair(path_a, path_b)
    return held["pair", path_a, path_b]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_file("byte_bpe_50k.json"), path_b or public_file("piece_bpe_32k.model")


def _blocks(kept: DataFrame, path_a: str, path_b: str, block_links: int) -> DataFrame:
    """One row a document with its distinct pairs, as places in its block's list of pairs, and one row a block with that list."""
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_products")
    fields = [StructField("block", LongType()), StructField("id", kept.schema["id"].dataType)]
    fields += [StructField(c, LongType()) for c in longs] + [StructField("groups_sha256", StringType())]
    fields += [StructField("at", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType()))]
    fields += [StructField("pairs", ArrayType(LongType())), StructField("n", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizer_pair(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        rows: list[tuple] = []
        met: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in met], np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            pairs, at = np.unique(np.concatenate(met), return_inverse=True)
            told = np.concatenate(times)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, told)
            listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            count = len(rows)
            columns = [pa.array(np.full(count, number)), pa.concat_arrays(ids)]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)] + [pa.array([r[5] for r in rows], pa.string())]
            columns += [listed(ends, at.astype(np.int32)), listed(ends, told.astype(np.int32))]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(count, pa.list_(pa.int64())), pa.nulls(count, pa.list_(pa.int64()))], names=names)
            own = [pa.array([number], pa.int64()), *(pa.nulls(1, c.type) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([*own, listed([0, len(pairs)], pairs), listed([0, len(pairs)], total)], names=names)

        held = 0
        for batch in slices(batches):
            first = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = both.align(text)
                if found is None:
                    rows.append((0, 0, 0, 0, 0, ""))
                    pairs, told = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    digest = hashlib.sha256(both.groups_text(found).encode()).hexdigest()
                    rows.append((len(found.a), len(found.b), found.n_groups, len(found.ends), found.group_products, digest))
                    pairs, told = np.unique(found.pairs, return_counts=True)
                    held += len(found.ends)
                met.append(pairs)
                times.append(told)
                if held >= block_links or len(rows) >= BLOCK_DOCUMENTS:
                    ids.append(batch.column(0).slice(first, row + 1 - first))
                    yield from block()
                    for kept_rows in (ids, rows, met, times):
                        kept_rows.clear()
                    number, held, first = number + 1, 0, row + 1
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if rows:
            yield from block()

    return kept.mapInArrow(run, StructType(fields))


def _told(blocks: DataFrame) -> DataFrame:
    """``block, at, pair, n``: each block's distinct pairs."""
    each = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "told"))
    return each.select("block", "at", F.col("told.pairs").alias("pair"), F.col("told.n").alias("n"))


def _counted(told: DataFrame) -> DataFrame:
    """``pair, count, best``: overlaps of each pair of tokens in the corpus, and whether no pair of its token of B has more."""
    counts = told.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    block_links: int = BLOCK_LINKS,
) -> DataFrame:
    """Alignment of every row: ``id, n_a, n_b, n_groups, n_links, n_products, n_best, count_sum, groups_sha256``.

    A is a byte-level BPE (``.json``) that reads a space and the text, B a sentencepiece model that reads the
    text and puts the space itself. ``n_links`` counts pairs of overlapping tokens, ``n_groups`` the stretches
    between ends that both share, ``n_products`` the pairs of tokens within one group. ``count_sum`` sums over the links how many links
    of the corpus join the same two ids, ``n_best`` counts those links whose pair is the most frequent of its
    id of B, ties included. ``groups_sha256`` hashes all groups' ids.

    Null and empty texts, and those that either side doesn't give back byte by byte, have no tokens: zeros and
    an empty hash. Rows are independent, so repeated rows and null ids are answered and counted as often as they come. Other columns are ignored;
    an empty table gives an empty result.

    Documents are tokenized once and written in blocks of about ``block_links`` overlaps. A block tells each of
    its pairs once, so what is counted and read back grows with the blocks' distinct pairs, not with the overlaps,
    and no pair's share of the overlaps gathers in a task.
    """
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(_blocks(kept, *_paths(path_a, path_b), block_links), "aligned")
    told = _told(blocks)
    counted = materialize(_counted(told), "pair_counts")
    back = told.join(counted, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_products"]
    own = blocks.where("pairs is null").select("block", "id", *numbers, "groups_sha256", "at", "times")
    kind = StructField("id", kept.schema["id"].dataType)
    out = [kind, *(StructField(c, LongType()) for c in (*numbers, "n_best", "count_sum")), StructField("groups_sha256", StringType())]

    def read(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        counts, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs.column("at").to_numpy()
        counts[place] = pairs.column("count").to_numpy()
        best[place] = pairs.column("best").to_numpy(zero_copy_only=False)
        sums: list[np.ndarray] = []
        for column in docs.select(["at", "times"]).to_batches():
            at, times = column.column(0), column.column(1)
            ends = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sums.append(np.stack([np.diff(np.concatenate(([0], np.cumsum(times * table[at])))[ends]) for table in (best, counts)]))
        n_best, count_sum = np.concatenate(sums, 1) if sums else np.zeros((2, 0), np.int64)
        told = [docs.column(c) for c in ("id", *numbers)] + [pa.array(n_best), pa.array(count_sum), docs.column("groups_sha256")]
        return pa.table(told, names=[f.name for f in out])

    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(read, StructType(out))


def pair_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, block_links: int = BLOCK_LINKS
) -> DataFrame:
    """How the two vocabularies meet in the corpus: ``a, b, count, best``, one row for each pair of ids that overlaps.

    The table with which vectors of one vocabulary are carried over to the other. Rows as in :func:`align`.
    """
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(_blocks(kept, *_paths(path_a, path_b), block_links), "aligned")
    ids = [F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b")]
    return _counted(_told(blocks)).select(*ids, "count", "best")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Every group of every row: ``id, group, start, end, a_ids, b_ids``; bytes count from the space before the text.

    Texts without tokens have no groups.
    """
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    path_a, path_b = _paths(path_a, path_b)
    ints = ArrayType(IntegerType())
    fields = [StructField("id", kept.schema["id"].dataType), *(StructField(c, LongType()) for c in ("group", "start", "end")), StructField("a_ids", ints), StructField("b_ids", ints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizer_pair(path_a, path_b)
        for batch in slices(batches, 64):
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = both.align(text)
                if found is None:
                    continue
                n = found.n_groups
                first_a, first_b = (np.searchsorted(g, np.arange(n + 1)) for g in (found.group_a, found.group_b))
                ends = np.cumsum(both.size_a[found.a])[first_a[1:] - 1]
                lists = [pa.ListArray.from_arrays(pa.array(f, pa.int32()), pa.array(i.astype(np.int32))) for f, i in ((first_a, found.a), (first_b, found.b))]
                places = [pa.array(x, pa.int64()) for x in (np.arange(n), np.append(0, ends[:-1]), ends)]
                own = batch.column(0).take(pa.array(np.full(n, row)))
                yield pa.RecordBatch.from_arrays([own, *places, *lists], names=[f.name for f in fields])

    return kept.mapInArrow(run, StructType(fields))


def group_products(found: DataFrame) -> DataFrame:
    """The products of :func:`groups` expanded: ``id, group, a, b``, one row for each pair of tokens within a group."""
    return found.select("id", "group", F.explode("a_ids").alias("a"), "b_ids").select("id", "group", "a", F.explode("b_ids").alias("b"))
