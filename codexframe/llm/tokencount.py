"""Token counts of whole texts: most pre-tokens are one token, so only the rest is merged.

Offline, each string of the vocabulary is proved to encode alone as one token. A text is then cut into
pre-tokens as its tokenizer cuts it: those of the proved strings count one each without any merging, and the
merges of the others are counted once per distinct pre-token and task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codexframe.llm.common import slices, worker_cache

#: Distinct pre-tokens whose merges a task remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 200_000, 64
#: Tokens of the model's context.
LIMIT = 1024


def public_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stay, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in printable)}
    return [moved.get(b, chr(b)) for b in range(256)]


def load_tokenizer(path: str):
    """The library's tokenizer of a ``.json`` file, without truncation and padding; read once per process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    held = worker_cache()
    if ("tokenizer", path) not in held:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        held["tokenizer", path] = tokenizer
    return held["tokenizer", path]


def has_shortcut(path: str) -> bool:
    """Whether the file is a byte-level BPE whose pre-tokens are cut straight from the text and merged one by one."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return bool(plain and model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("end_of_word_suffix"))


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that the model's merges turn into exactly the one token they name.

    A pre-token's tokens depend on its bytes alone, so each occurrence of such a string as a pre-token is one
    token. Entries that are no whole UTF-8 string can't be a pre-token. At most one string per entry.
    """
    tokenizer = load_tokenizer(path)
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    proved = []
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if [t.id for t in tokenizer.model.tokenize(entry)] != [number] or not all(c in byte_of for c in entry):
            continue
        try:
            proved.append(bytes(byte_of[c] for c in entry).decode("utf-8"))
        except UnicodeDecodeError:
            continue
    return frozenset(proved)


def latin_pattern(tokenizer) -> re.Pattern:
    """The library's cut for texts of code points below 256, each classed by how the library itself joins it to a neighbour."""
    one = lambda text: len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1
    kinds: dict[str, list[str]] = {"letter": [], "number": [], "other": [], "space": []}
    for c in map(chr, range(256)):
        kinds["letter" if one("a" + c) else "number" if one("1" + c) else "other" if one("!" + c) else "space"].append(re.escape(c))
    letter, number, other, space = ("[" + "".join(kinds[k]) + "]" for k in ("letter", "number", "other", "space"))
    # fixed values: the contractions of byte-level BPE's pre-tokenizer
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{space}+(?!{letter}|{number}|{other})|{space}+")


class Counter:
    """Counts the tokens of texts by whole tokens and remembered merges; one per task."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = load_tokenizer(path), whole
        held = worker_cache()
        if ("latin", path) not in held:
            held["latin", path] = latin_pattern(self.tokenizer)
        self.cut = held["latin", path].findall
        self.chars, self.merged = byte_chars(), {}
        with open(path, encoding="utf-8") as file:
            self.added = [t["content"] for t in json.load(file).get("added_tokens", [])]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut(text)

    def merge(self, piece: str) -> int:
        """Tokens of one pre-token by the model's merges."""
        found = self.merged.get(piece)
        if found is None:
            found = len(self.tokenizer.model.tokenize("".join(map(self.chars.__getitem__, piece.encode("utf-8")))))
            if len(piece) <= LONGEST:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[piece] = found
        return found

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and how many of these are whole tokens; added tokens' strings count as one token each."""
        if any(t in text for t in self.added):
            parts = re.split("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))), text)
            if len(self.tokenizer.encode(text, add_special_tokens=False).ids) != sum(self.count(p)[0] for p in parts) + len(parts) - 1:
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids), 0, 0
            counts = [self.count(p) for p in parts]
            return sum(c[0] for c in counts) + len(parts) - 1, sum(c[1] for c in counts), sum(c[2] for c in counts)
        pieces = self.pieces(text)
        rest = [p for p in pieces if p not in self.whole]
        direct = len(pieces) - len(rest)
        return direct + sum(map(self.merge, rest)), len(pieces), direct


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """Tokens of every row's whole text: ``id, n_bytes, n_tokens, over_limit, n_pieces, n_whole``.

    ``path`` is a tokenizer's file: ``.json`` of the tokenizers library, ``.model`` of sentencepiece. Counts are
    the library's without begin, end or other added special tokens; strings of special tokens inside a text are
    read as the library does by default. ``n_pieces`` and ``n_whole`` are its pre-tokens and those counted
    without merging; only a plain byte-level BPE has them, for any other file the library encodes each text and
    both are null. Null and empty texts have no bytes and no tokens; null ids and repeated rows stay as they
    are; an empty table gives an empty result. Other columns are ignored. No shuffle: rows are independent.
    """
    path = path or public_file()
    kept = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    quick = has_shortcut(path)
    # one string per vocabulary entry at most, whatever the corpus holds
    proved = df.sparkSession.sparkContext.broadcast(whole_tokens(path)) if quick else None
    counts = [StructField(c, LongType()) for c in ("n_bytes", "n_tokens", "n_pieces", "n_whole")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if quick:
            count = Counter(path, proved.value).count
        elif path.endswith(".json"):
            count = lambda text: (len(load_tokenizer(path).encode(text, add_special_tokens=False).ids), None, None)
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda text: (len(pieces.encode(text)), None, None)
        none = (0, 0, 0) if quick else (0, None, None)
        for batch in slices(batches):
            texts = batch.column(1)
            rows = [count(t) if t else none for t in texts.to_pylist()]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            columns = [pa.array([r[n] for r in rows], pa.int64()) for n in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, *columns], names=["id", "n_bytes", "n_tokens", "n_pieces", "n_whole"])

    found = kept.mapInArrow(run, StructType([StructField("id", kept.schema["id"].dataType), *counts]))
    return found.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pieces", "n_whole")
