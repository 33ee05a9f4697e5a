"""Byte-pair encoding and decoding of whole texts.

Encoding backtracks over longest token matches instead of merging pairs one by one: an
Aho-Corasick automaton gives, for every position of a word, the longest vocabulary token
that starts there; a token may follow another only if the two are *compatible*, that is, if
merging their joined characters by rank would leave exactly this pair. Where no compatible
token fits, the encoder goes back one token and tries the next shorter prefix. Each position
is given up at most once, so the work is linear in the word's length, and the outcome equals
the merge procedure's. Decoding copies slices of one byte string through an offset table.

Defined results: null and empty texts encode to no tokens and decode to "". Texts of any
length are encoded whole. Strings of special tokens in a text become special tokens, as in
the tokenizers library. Repeated rows give repeated rows; columns other than `id_col` and
`text_col` are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.session import ship, table

#: Words whose ids a worker remembers; the memory is emptied when it is full.
CACHE_WORDS = 400_000
_BEYOND = regex.compile(r"[^\x00-\u024f]")


def _byte_symbols() -> list[str]:
    """One printable character for each byte, as byte-level vocabularies write them."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder for one vocabulary file (`tokenizers` JSON, word-final suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._library = Tokenizer.from_file(path)
        self._symbol = _byte_symbols()
        self._written = dict(enumerate(self._symbol))
        self._byte = {s: b for b, s in enumerate(self._symbol)}
        # A symbol that ends a word is another letter of the alphabet: one code point above.
        self._final = {s: chr(0x10000 + ord(s)) for s in self._symbol}

        def letters(token: str) -> str:
            if token.endswith(suffix) and len(token) > len(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + self._final[body[-1]]
            return token

        self._letters = {letters(t): i for t, i in vocab.items()}
        pairs, halves, rank = {}, {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ids = vocab[a], vocab[b]
            made = vocab[a + b]
            pairs[ids] = r
            halves[made] = ids
            rank[made] = r
        self._pairs, self._halves, self._rank = pairs, halves, rank
        self._size = {i: len(s) for s, i in self._letters.items()}
        self._valid: dict[tuple[int, int], bool] = {}
        self._auto = ahocorasick.Automaton()
        for s, i in self._letters.items():
            if i not in halves or self._compatible(*halves[i], below=rank[i]):
                self._auto.add_word(s, i)
        self._auto.make_automaton()
        self._shorter = self._prefixes()
        strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            strings[i] = t.encode() + b" "
        self._bytes = np.frombuffer(b"".join(strings), np.uint8)
        self._offset = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self._cache: dict[str, tuple[int, ...]] = {}

    def _prefixes(self) -> dict[int, int]:
        """For each token, the longest other token that begins it."""
        out = {}
        for s, i in self._letters.items():
            for n in range(len(s) - 1, 0, -1):
                j = self._letters.get(s[:n])
                if j is not None and s[:n] in self._auto:
                    out[i] = j
                    break
        return out

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging the joined letters of two tokens leaves just these two.

        Both tokens are unmade, latest merge first; at each step a merge across the border
        would have come earlier than what is unmade next if its rank is below `limit`. An
        equal rank goes to the pair further left. `below`: only merges across the border
        earlier than this rank count, so the pair itself may then merge at `below`.
        """
        limit = 1 << 60 if below is None else below
        while True:
            r = self._pairs.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = self._rank.get(left, -1), self._rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = min(limit, a), self._halves[left][1]
            else:
                limit, right = min(limit, b + 1), self._halves[right][0]

    def _follows(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self._valid.get(key)
        if ok is None:
            if len(self._valid) > CACHE_WORDS:
                self._valid.clear()
            ok = self._valid[key] = self._compatible(left, right)
        return ok

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word of the pattern."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self._written)
        s = word[:-1] + self._final[word[-1]]
        whole = self._letters.get(s)
        if whole is not None and s in self._auto:
            return (whole,)
        n, size = len(s), self._size
        longest = [-1] * n
        for end, token in self._auto.iter(s):  # at one start, a later end is a longer token
            longest[end + 1 - size[token]] = token
        open_at, out, pos, token, last = bytearray(b"\1") * (n + 1), [], 0, longest[0], -1
        valid, shorter = self._valid, self._shorter
        while pos < n:
            while token >= 0:
                if open_at[pos + size[token]]:
                    if last < 0:
                        break
                    ok = valid.get((last, token))
                    if self._follows(last, token) if ok is None else ok:
                        break
                token = shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                pos += size[token]
                last, token = token, longest[pos] if pos < n else -1
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= size[token]
                last = out[-1] if out else -1
        return tuple(out)

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, as normalised. Python's regex and Unicode
        tables agree with the library's below U+0250; other texts are split by the library."""
        if _BEYOND.search(text) is None:
            return self._words.findall(text.lower())
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self._byte.__getitem__, w)).decode() for w, _ in words]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                cache = self._cache
                for w in self.words(part):
                    ids = cache.get(w)
                    if ids is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        ids = self.encode_word(w)
                        if len(w) <= 64:
                            cache[w] = ids
                    out.extend(ids)
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The token strings joined by one space."""
        if len(ids) == 0:
            return ""
        ids = np.asarray(ids, np.int64)
        start, length = self._offset[ids], self._offset[ids + 1] - self._offset[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self._bytes[at].tobytes()[:-1].decode("utf-8", errors="replace")


_LOADED: dict[str, BacktrackingBpe] = {}


def vocabulary(path: str) -> BacktrackingBpe:
    """The vocabulary of a file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """`id_col`, ids array<int> and the text that the ids decode to, a row for each row of `df`.

    `path` must exist on every worker (a vocabulary is part of the installation)."""
    ship(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array([bpe.decode(r) for r in rows], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encoded_length(df: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """n_tokens long, a row for each row of `df`: the length of its encoding, nothing kept."""
    ship(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            sizes = [len(bpe.encode(t)) for t in (v.as_py() for v in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return df.select(text_col).mapInArrow(run, "n_tokens long")


def digests(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """Like `encode`, with digests in place of the ids and the text, which stay on the worker."""
    ship(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = np.array(bpe.encode(value.as_py()), "<u4")
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of documents."""
    return digests(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
