"""Substring dedup by relative Lempel-Ziv parsing.

A reference block is a byte string of words with an index: the fingerprint of every run of
`window` words, and where it begins first. A text is parsed greedily against what comes earlier in
its block: at the first window with an earlier occurrence a *factor* begins, (source, start,
length), which goes on word by word, on the bytes themselves, as far as text and source agree. Where
it ends, the windows across its border are looked up on their own, each of which may begin the
next factor, so no match across a border is lost and it does not matter which of several
sources a factor takes (it takes the earliest). Factors of at least `window` words are the
duplicate spans; fingerprints only find them.

The corpus is dealt to blocks by anchors: the anchor of a window is its smallest k-gram hash, so
equal windows have equal anchors. Each task first parses its own documents against each other and
sends on only what is new there, in phrases (consecutive windows with one anchor, with their
words), so a copied passage costs a row a task however often it occurs. The block of the anchor then
parses all phrases it receives, in (document, position) order.

An anchor with very many different windows is dealt to several blocks by the windows' fingerprints,
so that equal windows still meet. A first pass counts: each part of a task reports the anchors
with more than a SHARE-th of its windows, so what goes unseen of an anchor is at most a
SHARE-th of all windows. The counts decide only where windows meet, not what is found.

The outcome is exact: a window counts as repeated if and only if the same word sequence
starts earlier (smaller id, or same document and earlier start).

Defined results: null, empty and short texts have no window and stay as they are. Rows with one
id and different texts are different documents, in the order of a digest of their text. Of rows with
equal id and text the first keeps its words, the others lose all of theirs (if they have a
window). Rows without an id come after all others. Other columns are ignored, or passed on by
`dedup_columns`, whatever their names. An empty table gives an empty table. A very long text is
parsed like any other; a task holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.words import gram_hashes, mix, plain, release, sliding_min, split_words, text_parts
from scriptorium.session import ship, table

#: Bytes of text that a task parses at once, and that one reference block and one place stand for.
PART_BYTES, BLOCK_BYTES = 3_000_000, 4_000_000
#: Bytes of text of the places that one task joins with their spans, one place after the other.
TASK_BYTES = 128_000_000
#: Words of an anchor.
ANCHOR = 5
#: Windows of one anchor that one block takes, and the share of a part that is reported.
SUB_WINDOWS, SHARE = 100_000, 20_000
#: Tasks that add up those counts.
COUNTERS = 32
#: Anchors with more windows, ascending, and the number of blocks for each.
Frequent = tuple[np.ndarray, np.ndarray]
NONE: Frequent = (np.empty(0, np.uint64), np.empty(0, np.uint64))
#: Where rows without an id stand in the order.
LAST = 2**63 - 1
#: A span of `windows` repeated windows from `start`, and its source: `from` in another document.
FACTOR = np.dtype([("id", "<i8"), ("digest", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("source", "<i8"), ("source_digest", "<i8"), ("from", "<i4")])

#: A phrase that a block receives: `windows` windows from `start` on, and the slice of the block in which windows like
#: these meet. Its words come beside it.
PHRASE = np.dtype([("id", "<i8"), ("digest", "<i8"), ("start", "<i4"), ("windows", "u1"), ("slice", "u1")])
#: Bits of a slice's number. Slices of a block are parsed one after the other: phrases overlap, so a block has several times
#: BLOCK_BYTES, and its index several times that.
SLICE_BITS = 2
_PHRASES = "block int, heads binary, words binary, spans binary"
#: Level of compression of the phrases of one row (neighbouring ones overlap in other rows only).
SQUEEZE = 3
#: A text of a part: id, digest, text.
Row = tuple[int, int, str]


def word_hashes(raw: bytes, at: np.ndarray) -> np.ndarray:
    """A hash of each word raw[at[i] : at[i + 1] - 1], eight bytes at a time for all words."""
    size = np.diff(at) - 1
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=raw + bytes(8), strides=(1,))
    low = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero(size <= 64)
    begin, left = at[rest], size[rest]
    while len(rest):
        h[rest] = mix(h[rest] ^ (eight[begin] & low[np.minimum(left, 8)]))
        more = left > 8
        rest, begin, left = rest[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i + 1] - 1])
    return h


@dataclass
class Reference:
    """Words of several pieces of text, pieces in order: `at` is where each word begins (and
    one beyond the last), `end` the first word after the piece of each."""

    raw: bytes
    at: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes], sizes: np.ndarray) -> Reference:
        """Pieces hold words with one space between them; those without a word are left out."""
        raw = b"\n".join(pieces)
        buf = np.frombuffer(raw, np.uint8)
        at = np.concatenate([[0], np.flatnonzero((buf == 32) | (buf == 10)) + 1, [len(raw) + 1]]) if raw else np.zeros(1, np.int64)
        return cls(raw, at, np.repeat(np.cumsum(sizes), sizes))

    def windows(self, window: int) -> np.ndarray:
        return np.flatnonzero(np.arange(len(self.end)) + window <= self.end)

    def common(self, w: int, s: int) -> int:
        """How many words agree from w and from s on, within their pieces."""
        raw, at = self.raw, self.at
        most = int(min(self.end[w] - w, self.end[s] - s))
        a, b = int(at[w]), int(at[s])
        size, same, step = int(min(at[w + most] - a, at[s + most] - b)) - 1, 0, 256
        while same < size:
            n = min(step, size - same)
            x, y = raw[a + same : a + same + n], raw[b + same : b + same + n]
            if x != y:
                same += int(np.flatnonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))[0])
                break
            same, step = same + n, 4 * step
        words = int(np.searchsorted(at, a + same, "right")) - 1 - w  # that end before the difference
        at_border = words < most and at[w + words + 1] - 1 - a == same == at[s + words + 1] - 1 - b
        return words + bool(at_border)


def factors(ref: Reference, window: int, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of a reference against itself: first word, source and number of words
    of each factor. `pos`: where windows begin, ascending; `key`: their fingerprints."""
    order = np.argsort(key, kind="stable")
    lead = np.arange(len(order))
    lead[1:][key[order[1:]] == key[order[:-1]]] = 0
    lead = np.maximum.accumulate(lead)
    first = np.empty(len(order), np.int64)
    first[order] = pos[order[lead]]
    hit = np.flatnonzero(first < pos)
    out, reach = [], 0
    for i, w, s in zip(hit.tolist(), pos[hit].tolist(), first[hit].tolist()):
        if w < reach:
            continue
        n = ref.common(w, s)
        if n < window:  # other words with this fingerprint: one of the later ones may be these
            others = pos[np.flatnonzero(key == key[i])].tolist()
            s, n = next(((o, c) for o in others if o < w and (c := ref.common(w, o)) >= window), (s, 0))
        if n >= window:
            out.append((w, s, n))
            reach = w + n - window + 1
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _runs(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of true positions over which `same` stay as they are."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    cut = np.diff(at) != 1
    for x in same:
        cut |= x[at[1:]] != x[at[:-1]]
    begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return at[begin], np.diff(np.concatenate([begin, [len(at)]]))


def _packed(found: np.ndarray, places: int) -> Iterator[tuple[int, bytes]]:
    """(place, factors) of each place: it is xxhash64(id, digest) modulo `places`, as Spark computes it."""
    docs, back = np.unique(found[["id", "digest"]], return_inverse=True)
    one = lambda x, seed: xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed=seed)
    place = (np.array([one(d, one(i, 42)) for i, d in docs.tolist()], np.uint64).astype(np.int64) % places)[back.reshape(-1)]
    order = np.argsort(place, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]]) if len(order) else []
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(place[order[a]]), found[order[a:b]].tobytes()


def _referenced(rows: list[Row], window: int) -> tuple:
    """A part of the documents as one reference, equal rows once, in order: ids, digests, first
    word and number of words of each document with a window; the reference; its windows."""
    ids, digests, sizes, pieces = [], [], [], []
    for (i, d), text in sorted({(i, d): t for i, d, t in rows}.items()):
        words = split_words(text)
        if len(words) >= window:
            ids.append(i)
            digests.append(d)
            sizes.append(len(words))
            pieces.append(b" ".join(words))
    ids, digests, sizes = (np.array(x, np.int64) for x in (ids, digests, sizes))
    ref = Reference.of(pieces, sizes)
    pos = ref.windows(window)
    h = word_hashes(ref.raw, ref.at)
    k = min(ANCHOR, window)
    anchor = sliding_min(gram_hashes(h, k), window - k + 1)[pos] if len(pos) else np.empty(0, np.uint64)
    key = gram_hashes(h, window)[pos] if len(pos) else np.empty(0, np.uint64)
    return ids, digests, np.cumsum(sizes) - sizes, sizes, ref, pos, anchor, key


def _counts(rows: list[Row], window: int) -> pa.RecordBatch:
    """Anchors of one part that have many different windows, and how many, packed by anchor."""
    *_, anchor, key = _referenced(rows, window)
    anchor, n = np.unique(anchor[np.unique(key, return_index=True)[1]], return_counts=True)
    many = n > n.sum() // SHARE
    anchor, n = anchor[many], n[many]
    place = mix(anchor) % np.uint64(COUNTERS)
    rows = [(p, anchor[place == p].astype("<u8").tobytes(), n[place == p].astype("<i8").tobytes()) for p in np.unique(place).tolist()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["place", "anchors", "counts"])


def _summed(group: pa.Table, least: int) -> pa.Table:
    """The anchors of one place with over `least` windows."""
    join = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), kind)
    anchor, of = np.unique(join("anchors", "<u8"), return_inverse=True)
    n = np.zeros(len(anchor), np.int64)
    np.add.at(n, of, join("counts", "<i8"))
    return pa.table({"anchor": pa.array(anchor[n > least].view(np.int64)), "n": pa.array(n[n > least])})


def _phrases(rows: list[Row], window: int, blocks: int, frequent: Frequent = NONE) -> pa.RecordBatch:
    """What one part of the documents sends to the reference blocks, and its own factors."""
    ids, digests, first, sizes, ref, pos, anchor, key = _referenced(rows, window)
    out: list[tuple] = []
    if len(pos):
        doc = np.repeat(np.arange(len(ids)), sizes)
        begin, source, n = factors(ref, window, pos, key)
        own = np.empty(len(begin), FACTOR)
        own["id"], own["digest"], own["start"], own["windows"] = ids[doc[begin]], digests[doc[begin]], begin - first[doc[begin]], n - window + 1
        own["source"], own["source_digest"], own["from"] = ids[doc[source]], digests[doc[source]], source - first[doc[source]]
        out += [(-1 - place, None, None, spans) for place, spans in _packed(own, blocks)]
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + n - window + 1, -1)
        new = np.cumsum(edge)[pos] == 0
        sub = np.zeros(len(key), np.uint64)
        if len(frequent[0]):
            of = np.minimum(np.searchsorted(frequent[0], anchor), len(frequent[0]) - 1)
            hit = frequent[0][of] == anchor
            sub[hit] = key[hit] % frequent[1][of[hit]]
        b, n = _runs(new, doc[pos], anchor, sub)
        while len(n) and n.max() > 255:  # counts take one byte
            b, n = np.concatenate([b, b[n > 255] + 255]), np.concatenate([np.minimum(n, 255), n[n > 255] - 255])
        value = mix(anchor[b] + sub[b] * np.uint64(0x9E3779B97F4A7C15))
        block = (value % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((b, block))
        w, n, block, value = pos[b[order]], n[order], block[order], value[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(b) else []
        from_, to = ref.at[w].tolist(), (ref.at[w + n + window - 1] - 1).tolist()
        heads = np.empty(len(w), PHRASE)
        heads["id"], heads["digest"], heads["start"], heads["windows"] = ids[doc[w]], digests[doc[w]], w - first[doc[w]], n
        heads["slice"] = value >> np.uint64(64 - SLICE_BITS)
        squeeze = zstandard.ZstdCompressor(SQUEEZE).compress
        for x, y in zip(cut[:-1], cut[1:]):
            words = b"\n".join([ref.raw[i:j] for i, j in zip(from_[x:y], to[x:y])])
            out.append((int(block[x]), squeeze(heads[x:y].tobytes()), squeeze(words), None))
    kinds = [pa.int32(), *[pa.binary()] * 3]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _PHRASES.split(", ")])


def _slice_factors(heads: np.ndarray, pieces: list[bytes], window: int) -> np.ndarray:
    """The factors of some phrases, parsed in (document, position) order."""
    order = np.lexsort((heads["start"], heads["digest"], heads["id"]))
    heads = heads[order]
    ids, digests, starts, n = heads["id"].copy(), heads["digest"].copy(), heads["start"].astype(np.int64), heads["windows"].astype(np.int64)
    ref = Reference.of([pieces[i] for i in order.tolist()], n + window - 1)
    pos, piece = ref.windows(window), np.repeat(np.arange(len(n)), n)
    base = starts - (np.cumsum(n + window - 1) - (n + window - 1))  # number in the document, less that in the reference
    same = (ids[1:] == ids[:-1]) & (digests[1:] == digests[:-1])
    if (same & (starts[1:] < starts[:-1] + n[:-1])).any():  # equal rows in two parts: each window once
        document = np.concatenate([[0], np.cumsum(~same)])[piece]
        once = np.sort(np.unique(document << 32 | pos + base[piece], return_index=True)[1])
        pos, piece = pos[once], piece[once]
    begin, source, words = factors(ref, window, pos, gram_hashes(word_hashes(ref.raw, ref.at), window)[pos])
    p, q = (piece[np.searchsorted(pos, x)] for x in (begin, source))
    found = np.empty(len(begin), FACTOR)
    found["id"], found["digest"], found["start"], found["windows"] = ids[p], digests[p], begin + base[p], words - window + 1
    found["source"], found["source_digest"], found["from"] = ids[q], digests[q], source + base[q]
    return found


def _parsed(group: pa.Table, window: int, places: int) -> pa.Table:
    """Parse what one reference block received, slice by slice; its factors, packed by place.

    Negative blocks hold what the tasks found on their own; it goes through as it is."""
    release()
    known = group["spans"].is_valid()
    out = [(-1 - b, x) for b, x in zip(group["block"].filter(known).to_pylist(), group["spans"].filter(known).to_pylist())]
    sent = group.filter(pc.invert(known))
    if len(sent):
        whole = zstandard.ZstdDecompressor().decompress
        heads = [np.frombuffer(whole(x.as_py()), PHRASE) for x in sent["heads"]]
        found = []
        for k in np.unique(np.concatenate([np.unique(h["slice"]) for h in heads])).tolist():
            own, pieces = [], []
            for h, x in zip(heads, sent["words"]):  # unpacked again for each slice: words of one row at a time
                at = np.flatnonzero(h["slice"] == k)
                if len(at):
                    words = whole(x.as_py()).split(b"\n")
                    own.append(h[at])
                    pieces += [words[i] for i in at.tolist()]
            found.append(_slice_factors(np.concatenate(own), pieces, window))
            del own, pieces
            release()
        out += _packed(np.concatenate(found), places)
    return pa.table({"place": pa.array([x[0] for x in out], pa.int32()), "spans": pa.array([x[1] for x in out], pa.binary())})


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _by_part(docs: DataFrame, made: Callable[[list[Row]], pa.RecordBatch], names: str) -> DataFrame:
    """`made` of the rows (id, digest, text) of each part of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for a, b in text_parts(batch, 2, PART_BYTES):
                more = list(zip(*(batch.column(c)[a:b].to_pylist() for c in range(3))))
                rows += more
                held += sum(len(t) for _, _, t in more)
                if held >= PART_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.where("text is not null").mapInArrow(run, names)


def frequent_anchors(docs: DataFrame, window: int) -> Frequent:
    """Anchors with over SUB_WINDOWS windows: fewer than one for so many windows of all."""
    counts = _by_part(docs, lambda rows: _counts(rows, window), "place int, anchors binary, counts binary")
    least = SUB_WINDOWS
    rows = counts.groupBy("place").applyInArrow(lambda group: _summed(group, least), "anchor long, n long").collect()
    found = sorted((r.anchor % 2**64, -(-r.n // SUB_WINDOWS)) for r in rows)
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.uint64)


def _documents(id_col: str, text_col: str) -> list[Column]:
    """id (for the order), digest, text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")]


def repeated_spans(docs: DataFrame, window: int, blocks: int) -> DataFrame:
    """place, spans: the factors (FACTOR) of documents (id, digest, text), packed by the places of
    the documents. Factors of one document may touch or overlap."""
    frequent = frequent_anchors(docs, window)
    sent = _by_part(docs, lambda rows: _phrases(rows, window, blocks, frequent), _PHRASES)
    return sent.groupBy("block").applyInArrow(lambda group: _parsed(group, window, blocks), "place int, spans binary")


def duplicate_factors(df: DataFrame, id_col: str, text_col: str, window: int = 20) -> DataFrame:
    """id, start, words, source_id, source_start: `words` words of document id from word `start` on
    are those of source_id from source_start on. Rows equal in id and text count once."""
    ship(df.sparkSession)
    docs = df.select(*_documents(id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spans in batch.column(0).to_pylist():
                x = np.frombuffer(spans, FACTOR)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x["id"], x["start"], x["windows"] + np.int32(window - 1), x["source"], x["from"])], names=["id", "start", "words", "source_id", "source_start"])

    found = repeated_spans(docs, window, max(1, _bytes(docs) // BLOCK_BYTES)).select("spans").mapInArrow(run, "id long, start int, words int, source_id long, source_start int")
    return found.withColumns({c: F.nullif(c, F.lit(LAST)) for c in ("id", "source_id")})


#: Spans of a document: rows of first window and number of windows, or WHOLE for all there are.
WHOLE = None


def _covered(spans: np.ndarray | None, n_words: int, window: int) -> np.ndarray:
    if spans is WHOLE:
        return np.full(n_words, n_words >= window)
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, spans["start"], 1)
    np.add.at(edge, spans["start"] + spans["windows"] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(df: DataFrame, id_col: str, text_col: str, window: int, finish, names: str, keep: list[str] = []) -> DataFrame:
    """Bring spans and texts together by place: a task holds a place's spans and streams
    over its texts. The result has the columns `keep` of `df` and those of `finish`."""
    ship(df.sparkSession)
    docs = df.select(*_documents(id_col, text_col))
    total = _bytes(docs)
    places = max(1, total // BLOCK_BYTES)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    rest = F.struct(F.col(id_col).cast("long").alias("_id"), *keep).alias("rest")
    whole = df.select(*_documents(id_col, text_col), rest)
    whole = whole.select(F.pmod(F.xxhash64("id", "digest"), F.lit(places)).cast("int").alias("place"), F.lit(1).alias("kind"), "id", "digest", "text", F.lit(None).cast("binary").alias("spans"), "rest")
    none = lambda c: F.lit(None).cast(whole.schema[c].dataType).alias(c)
    spans = repeated_spans(docs, window, places).select("place", F.lit(0).alias("kind"), none("id"), none("digest"), none("text"), "spans", none("rest"))
    types = {"long": pa.int64(), "string": pa.string()}
    made = [x.split() for x in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, known, ids, last = None, [], np.empty(0, FACTOR), np.empty(0, np.int64), None
        for batch in batches:
            for a, b in text_parts(batch, 4, PART_BYTES):
                out, at = [], []
                part = batch.slice(a, b - a)
                for row, (place, kind, i, digest, text, packed) in enumerate(zip(*(part.column(k).to_pylist() for k in range(6)))):
                    if place != of:
                        of, held, known, ids, last = place, [], known[:0], ids[:0], None
                    if kind == 0:
                        held.append(packed)
                        continue
                    if held:
                        known, held = np.frombuffer(b"".join(held), FACTOR), []
                        known = known[np.argsort(known["id"], kind="stable")]
                        ids = np.ascontiguousarray(known["id"])
                    if (i, digest) == last and text is not None:
                        own = WHOLE  # a copy of the row before
                    else:
                        own = known[np.searchsorted(ids, i, "left") : np.searchsorted(ids, i, "right")]
                        own = own[own["digest"] == digest]
                    last = i, digest
                    at.append(row)
                    out.append(finish(text, own))
                columns = list(zip(*out)) if out else [()] * len(made)
                columns = [pa.array(c, types[t]) for c, (_, t) in zip(columns, made)]
                kept = part.column(6).take(pa.array(at, pa.int64())).flatten()
                yield pa.RecordBatch.from_arrays([kept[0], *columns, *kept[1:]], names=["_id", *(n for n, _ in made), *keep])

    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = spans.unionByName(whole).repartition(tasks, "place").sortWithinPartitions("place", "kind", "id", "digest")
    return rows.mapInArrow(run, f"_id long, {names}{kinds}")


def _cut(text: str | None, spans: np.ndarray | None, window: int) -> tuple:
    """The text without its repeated words and the white space after them; words; removed."""
    words = split_words(text)
    gone = _covered(spans, len(words), window)
    if not gone.any():
        return text, len(words), 0
    raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
    for i, w in enumerate(words):
        begin = raw.index(w, at)
        if i and not gone[i - 1] and begin > at:
            kept.append(raw[at:begin])
        at = begin + len(w)
        if not gone[i]:
            kept.append(w)
    return b"".join(kept).decode("utf-8", "surrogatepass"), len(words), int(gone.sum())


def dedup_texts(df: DataFrame, id_col: str, text_col: str, window: int = 20) -> DataFrame:
    """id, kept_text, n_words, n_removed. Texts without a repeat stay as they are; from
    others the removed words go, with the white space after them."""
    out = _apply(df, id_col, text_col, window, lambda text, spans: _cut(text, spans, window), "kept_text string, n_words long, n_removed long")
    return out.withColumnRenamed("_id", "id")


def dedup_columns(df: DataFrame, id_col: str, text_col: str, window: int = 20) -> DataFrame:
    """`df` with the repeated passages cut from its texts; all other columns as they are."""
    own, at = plain(df)
    keep = [c for c in own.columns if c != at[text_col]]
    cut = _apply(own, at[id_col], at[text_col], window, lambda text, spans: _cut(text, spans, window)[:1], "kept_text string", keep)
    return cut.select(*[F.col("kept_text" if c == at[text_col] else c) for c in own.columns]).toDF(*df.columns)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every whole text of documents, windows of 20."""

    def finish(text: str | None, spans: np.ndarray | None) -> tuple:
        words = split_words(text)
        gone = _covered(spans, len(words), 20)
        kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    out = _apply(table(spark, sf_dir, "documents"), "doc_id", "text", 20, finish, "n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("_id", "doc_id")
