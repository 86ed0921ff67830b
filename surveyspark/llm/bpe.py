"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A merge encoding is determined by its adjacent pairs: a token sequence is *the* encoding
of its bytes exactly when every adjacent pair is the encoding of its own two tokens. So
every byte prefix has one valid last token, and the last token of prefix ``i`` is the only
token ``t`` ending at ``i`` that is compatible with the last token of prefix
``i - len(t)``. ``PrefixEncoding`` stores that token for every prefix: appending bytes only
extends the table, and an edit keeps every prefix in front of it.

Edge cases: a null text encodes as the empty text (0 tokens, digest of the empty string);
very long texts and very long matches are encoded whole (the table is linear in the match);
repeated rows give repeated results; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.words import returning, slices, stream

TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
# bounds of the per-worker look-ups; they only save time, results do not depend on them
CACHE_ENTRIES, CACHE_PAIRS = 120_000, 1_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairRules:
    """Which two tokens may stand side by side in a merge encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        # the two tokens whose merge makes a token; a single byte is its own half
        self.halves = {r: self._halves(t, r) for t, r in ranks.items()}
        # a token that merging never ends in only stands for a whole match
        usable = {t: r for t, r in ranks.items() if self.halves[r]}
        # every end of a usable token -> its rank, or -1 when that end is no token itself
        self.ends = {t[k:]: -1 for t in usable for k in range(1, len(t))} | usable
        self.fits = _Fits(self)

    def merged(self, data: bytes, stop_at: int = 1) -> list[int]:
        """Plain merging by lowest rank, leftmost first, until ``stop_at`` parts are left."""
        ranks, parts = self.ranks, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop_at:
            found = [(ranks.get(x + y, _NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            best, at = min(found)
            if best == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, data: bytes, rank: int) -> tuple[int, int] | None:
        if len(data) == 1:
            return rank, rank
        two = self.merged(data, stop_at=2)
        return (two[0], two[1]) if len(two) == 2 else None

    def no_crossing(self, left: int, right: int) -> bool:
        """True when no merge crosses the border between ``left`` and ``right``.

        Undo the latest merge on either side, again and again; the border pair at each level
        must not have a rank that would have been merged before the merge just undone."""
        text, ranks, halves, before = self.text, self.ranks, self.halves, _NEVER
        while True:
            if ranks.get(text[left] + text[right], _NEVER) < before:
                return False
            left_whole, right_whole = len(text[left]) > 1, len(text[right]) > 1
            if left_whole and (left > right or not right_whole):
                before, left = left, halves[left][1]  # equal ranks: the one further left goes first
            elif right_whole:
                before, right = right + 1, halves[right][0]
            else:
                return True


_NEVER, _MASK = 1 << 60, (1 << 64) - 1


class _Fits(dict):
    """left token << 32 | right token -> may they stand side by side? Bounded; filled on demand."""

    def __init__(self, rules: PairRules):
        super().__init__()
        self.rules = rules

    def __missing__(self, key: int) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        found = self[key] = self.rules.no_crossing(key >> 32, key & 0xFFFFFFFF)
        return found


class PrefixEncoding:
    """The last token of every byte prefix of one match, with exact appends and edits."""

    def __init__(self, rules: PairRules, data: bytes = b""):
        self.rules, self.data, self.last = rules, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        ends, fits, last, start = self.rules.ends.get, self.rules.fits, self.last, len(self.data)
        self.data = data = self.data + more
        for end in range(start + 1, len(data) + 1):
            begin, ending = end - 1, []  # tokens that end here, shortest first
            while begin >= 0 and (token := ends(data[begin:end])) is not None:
                if token >= 0:
                    ending.append((begin, token))
                begin -= 1
            for begin, token in reversed(ending):
                if not begin or fits[last[begin] << 32 | token]:
                    last.append(token)
                    break

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Put ``new`` for bytes ``begin:end``. Prefixes in front of the edit are kept; behind
        it, the old table is taken over once ``longest`` prefixes in a row have the same last
        token as before (a prefix looks back at most that far)."""
        tail, old_last = self.data[end:], self.last
        self.data, self.last = self.data[:begin], self.last[:begin + 1]
        self.append(new)
        shift, same = end - len(self.data), 0
        for k in range(len(tail)):
            self.append(tail[k:k + 1])
            here = len(self.data)
            same = same + 1 if self.last[here] == old_last[here + shift] else 0
            if same >= self.rules.longest:
                self.data += tail[k + 1:]
                self.last += old_last[here + shift + 1:]
                break

    def ids(self) -> list[int]:
        out, at, text = [], len(self.data), self.rules.text
        while at:
            out.append(self.last[at])
            at -= len(text[out[-1]])
        return out[::-1]


class PrefixTable:
    """``PrefixEncoding`` for many short matches at once: row r, column i holds the last token
    of the first i bytes of match r."""

    WIDTH = 48  # longer matches go through PrefixEncoding

    def __init__(self, rules: PairRules):
        self.rules = rules
        self.size = np.array([len(rules.text.get(r, b"")) for r in range(max(rules.text) + 1)], np.int32)
        # a hash of every end of a token, read from its last byte to its first
        self.byte = stream(91, 256)
        self.place = stream(92, rules.longest) | np.uint64(1)
        ends = list(rules.ends.items())
        with np.errstate(over="ignore"):
            keys = np.array([sum(int(self.byte[c]) * int(self.place[k]) for k, c in enumerate(t[::-1])) & _MASK
                             for t, _ in ends], np.uint64)
        # two look-up tables: an end whose slot in the first is taken stands in the second
        self.keys, self.tokens = np.append(keys, np.uint64(0)), np.array([r for _, r in ends] + [-2], np.int32)
        self.first = np.full(1 << 21, len(ends), np.int32)
        self.first[self._slot(keys, 0)] = np.arange(len(ends))
        left = np.flatnonzero(self.first[self._slot(keys, 0)] != np.arange(len(ends)))
        for salt in range(1, 1000):
            slots = self._slot(keys[left], salt)
            if len(np.unique(slots)) == len(left):
                break
        else:
            raise ValueError("no collision-free second table")
        self.salt, self.second = salt, np.full(1 << 21, len(ends), np.int32)
        self.second[slots] = left
        # known pairs, one per slot; a newer pair takes the place of an older one
        self.pair = np.full(1 << 21, -1, np.int64)
        self.fit = np.zeros(1 << 21, bool)

    @staticmethod
    def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * (stream(100 + salt, 1) | np.uint64(1)) >> np.uint64(43)).astype(np.int64)

    def _end_token(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token with this hash, -1 for an end of tokens only, -2 for neither."""
        at = self.first[self._slot(keys, 0)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = self.second[self._slot(keys[other], self.salt)]
        found = self.tokens[at]
        found[self.keys[at] != keys] = -2
        return found

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key.astype(np.uint64), 0)
        out, miss = self.fit[slot], np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            known = np.array([self.rules.no_crossing(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            out[miss] = known[back]
            self.pair[slot[miss]] = key[miss]
            kept = self.pair[slot[miss]] == key[miss]  # of two pairs of one slot one is kept
            self.fit[slot[miss[kept]]] = known[back[kept]]
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every piece (each of 1 to WIDTH bytes)."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        size = np.array([len(pieces[i]) for i in order], np.int64)
        n, width = len(order), int(size[0]) if len(order) else 0
        if not n:
            return []
        flat = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order]), np.uint8)
        data = np.ascontiguousarray(flat.reshape(n, width).T)  # one row per byte place
        last = np.full((width + 1, n), -1, np.int32)
        with np.errstate(over="ignore"):
            for end in range(1, width + 1):
                rows = np.arange(np.searchsorted(-size, -end, "right"))
                ending, key = [], np.zeros(len(rows), np.uint64)
                for begin in range(end - 1, max(-1, end - 1 - self.rules.longest), -1):
                    key = key + self.byte[data[begin, rows]] * self.place[end - 1 - begin]
                    token = self._end_token(key)
                    is_token = token >= 0
                    ending.append((begin, rows[is_token], token[is_token]))
                    more = token > -2
                    rows, key = rows[more], key[more]
                    if not len(rows):
                        break
                now = last[end]
                for begin, rows, token in reversed(ending):  # the longest first
                    open_ = now[rows] < 0
                    rows, token = rows[open_], token[open_]
                    if begin:
                        good = self._fits(last[begin, rows], token)
                        rows, token = rows[good], token[good]
                    now[rows] = token
        out: list[list[int]] = [[] for _ in range(n)]
        at, rows = size.copy(), np.arange(n)
        while len(rows):
            token = last[at[rows], rows]
            for r, t in zip(rows.tolist(), token.tolist()):
                out[order[r]].append(t)
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        return [ids[::-1] for ids in out]


class _Seen:
    """Bounded look-up in two generations: when the younger is full it becomes the older one,
    and what is used again is carried over."""

    def __init__(self, limit: int):
        self.limit, self.now, self.older = limit, {}, {}

    def learn(self, keys: set, make) -> dict:
        """A look-up that holds every one of ``keys``; ``make`` gives the values of new ones."""
        if len(self.now) >= self.limit:
            self.now, self.older = {}, self.now
        new = keys - self.now.keys()
        if new:
            again = new & self.older.keys()
            self.now.update((k, self.older[k]) for k in again)
            self.now.update(make(new - again))
        return self.now


class Codec:
    """Encoder and decoder of one rank file; matches and words already seen are looked up."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.rules = PairRules(load_ranks(path))
        self.table = PrefixTable(self.rules)
        self.matches = regex.compile(pattern).findall
        self.wide_space = regex.compile(r"\s\s").search
        self.bytes_of = {str(r): t for r, t in self.rules.text.items()}
        self.match_ids, self.word_ids = _Seen(CACHE_ENTRIES), _Seen(CACHE_ENTRIES)

    def _new_matches(self, pieces: set[str]) -> dict[str, str]:
        out, short = {}, []
        for piece in pieces:
            data = piece.encode("utf-8")
            whole = self.rules.ranks.get(data)
            if whole is not None:
                out[piece] = str(whole)
            elif len(data) > PrefixTable.WIDTH:
                out[piece] = ",".join(map(str, PrefixEncoding(self.rules, data).ids()))
            else:
                short.append((piece, data))
        ids = self.table.encode([d for _, d in short])
        out.update((p, ",".join(map(str, i))) for (p, _), i in zip(short, ids))
        return out

    def _new_words(self, words: set[str]) -> dict[str, str]:
        pieces = {w: self.matches(w) for w in words}
        ids = self.match_ids.learn({p for found in pieces.values() for p in found}, self._new_matches)
        return {w: ",".join([ids[p] for p in found]) for w, found in pieces.items()}

    def words(self, text: str) -> list[str]:
        """Parts of a text that can be encoded one by one. A match never runs past a single
        space that stands between two other characters (it can only begin with it), so a
        text without neighbouring white space falls into its words, each with the space in
        front; any other text falls into its matches."""
        if self.wide_space(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def encode_joined(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by commas, of every text."""
        parts = [self.words(t) for t in texts]
        ids = self.word_ids.learn(set().union(*parts), self._new_words).__getitem__
        return [",".join(map(ids, p)) for p in parts]

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined([text])[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))) if joined else b""

    def decode(self, ids) -> bytes:
        return b"".join(map(self.rules.text.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per task and rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def drop_codecs() -> None:
    """A worker that waits for another task holds no tables and no look-ups."""
    _CODECS.clear()


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode every text: ``id_col, n_tokens, ids_sha256, decoded_sha256`` and,
    with ``with_ids``, the token ids. Row-local: no shuffle, memory bounded by one batch."""
    import public_tokenizers

    path, pattern = path or tokenizer_path(), pattern or public_tokenizers.PATTERN
    schema = SCHEMA.replace("doc_id", "id") + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern), hashlib.sha256
        for batch in batches:
            for at, end in slices(batch.column(1)):
                part = batch.slice(at, end - at)
                joined = c.encode_joined([t or "" for t in part.column(1).to_pylist()])
                cols = [
                    part.column(0),
                    pa.array([j.count(",") + 1 if j else 0 for j in joined], pa.int64()),
                    pa.array([sha(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([sha(c.decode_joined(j)).hexdigest() for j in joined], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([list(map(int, j.split(","))) if j else [] for j in joined],
                                         pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(returning(run, drop_codecs), schema).withColumnRenamed("id", id_col)
