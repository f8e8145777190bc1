"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is normalised as the model says (spaces become U+2581, one is put in front), then read
character by character.  A position keeps the best way to segment everything before it: its last
piece, that is a backpointer, and its score.  Only positions at which a piece may begin that goes on beyond what
is read, in a window as long as the longest piece, can still be extended, so only their paths survive; as soon as the paths of all of them pass
through one boundary, the ids up to it are final and are handed on.  Memory is bounded by the
window and what lies between two such boundaries, whatever the text's length.

Scores follow the model's type.  unigram: the sum of piece scores, the greatest wins, ties to the
longer last piece.  bpe: a segmentation is the library's encoding exactly if each two adjacent
pieces are what merging would make of them together; a position has one such path, all others
score minus infinity, so ids equal the library's.  Characters without a piece fall back to their
bytes (or to the unknown id).

Long texts come in portions of PORTION characters.  Where two characters meet that stand side by side in
no piece, every path has a boundary between them: all paths converge there without following them, so what lies
before the last such place of a portion is committed, and the rest opens the next.  Between these places lie
stretches, and the search reads each distinct one character by character, tries for a commitment from TRY
open characters on, and hands on what is settled; a memo holds the ids of the short ones.  A stretch longer
than a portion is searched as its characters come, in the window alone.  Short texts of a buffer go through the
same search together.

Defined cases: null and empty texts have no ids; decoding gives the text back, except where the
normaliser or the unknown id lost something (`piece_bpe_32k` keeps every character).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import kept, lean, ranges, slices
from quern.llm.memo import PieceMemo

SPACE = "▁"
#: Characters of a portion; open characters from which on a commitment is tried, and after how many more again.
PORTION, TRY, AGAIN = 1 << 16, 6, 3
#: Texts that tell whether a model's normaliser does more than to put spaces as U+2581.
_PROBES = ("a", " a  b ", "\ta\n\nb", "\ufb01\uff21\u00bd", "e\u0301\u00e9", "\u00a0a\u3000b\u200b", "\x00\x01\x7f", "")


class Pieces:
    """The vocabulary of a SentencePiece model, and the streaming search over it."""

    def __init__(self, path: str, keep: int = 1_500_000):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.vocab_size()
        kind = [(self.lib.is_byte(i), self.lib.is_control(i), self.lib.is_unknown(i), self.lib.is_unused(i)) for i in range(n)]
        self.piece = [self.lib.id_to_piece(i) for i in range(n)]
        self.score = [self.lib.get_score(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if not any(kind[i])}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if kind[i][0]}
        self.unknown = self.lib.unk_id()
        self.longest = max(map(len, self.id))
        scores = [self.score[i] for i in self.id.values()]
        # A model made by merging ranks its pieces by whole numbers; a unigram model has log-probabilities.
        self.merged = all(x == int(x) for x in scores)
        self.floor = min(scores) - 10
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k[0] else b"" if k[1] or k[2] else p.encode() for p, k in zip(self.piece, kind)]
        self.tails = {p[i:] for p in self.id for i in range(len(p))}
        self.heads = {p[:i] for p in self.id for i in range(1, len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.committed = 0  # portions that were handed on because all paths met
        self.widest = 0  # the most characters that were open at a time
        self.plain = all(self.lib.normalize(t) == (SPACE + t.replace(" ", SPACE) if t else "") for t in _PROBES)
        self.kind = np.uint16 if n <= 65536 else np.uint32
        self.memo = PieceMemo(self._stretches, self.kind, keep)
        chars = sorted({c for p in self.id for c in p if ord(c) < 0x10000})
        self.char = np.zeros(0x10000, np.int32)  # the pieces' characters, numbered from 1
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        self.wide = any(ord(c) >= 0x10000 for p in pairs for c in p)
        known = [(ord(a), ord(b)) for a, b in pairs if max(a, b) < "\U00010000"]
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if known:
            self.joins[self.char[[a for a, _ in known]], self.char[[b for _, b in known]]] = True
        pool = [p.replace(SPACE.encode(), b" ") for p in self.bytes_of]
        self.pool, self.pool_size = np.frombuffer(b"".join(pool), np.uint8), np.array([len(p) for p in pool])
        self.pool_at = np.cumsum(self.pool_size) - self.pool_size

    def merge(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text: best-ranked pair first, then leftmost."""
        part = list(text)
        while len(part) > 1:
            ranked = [(self.score[self.id[a + b]], -i) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.id]
            if not ranked:
                break
            i = -max(ranked)[1]
            part[i : i + 2] = [part[i] + part[i + 1]]
        return part

    def adjacent(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[key] = self.merge(a + b) == ([a, b] if a else [b])
        return self.fits[key]

    def stream(self, chars) -> Iterator[tuple[int, ...]]:
        """Ids in committed portions, for an iterable of normalised characters."""
        window = ""  # the characters since the last commitment
        last: list[str | None] = [""]  # last[i]: last piece of the best path to position i of the window
        best = [0.0]
        before = ""  # the piece that the last commitment ended with
        step = self.best_merged if self.merged else self.best_scored
        due = TRY
        for c in chars:
            window += c
            piece, score = step(window, last, best, before)
            last.append(piece)
            best.append(score)
            if len(last) > due:
                self.widest = max(self.widest, len(window))
                common = self.converged(window, last, best)
                if common:
                    self.committed += 1
                    parts = self.back(last, common)
                    yield tuple(i for p in parts for i in self.ids_of(p))
                    before = parts[-1]
                    window, last, best = window[common:], ["", *last[common + 1 :]], [0.0, *(x - best[common] for x in best[common + 1 :])]
                due = max(TRY, len(last) + AGAIN)
        if len(last) > 1:
            yield tuple(i for p in self.back(last, len(last) - 1) for i in self.ids_of(p))

    def best_merged(self, window, last, best, before):
        """The one last piece under which the path to the window's end is the library's."""
        end, known, fits, tails = len(window), self.id, self.fits, self.tails
        p = window[-1]
        prior = last[end - 1] if end > 1 else before
        if prior is not None and (fits.get((prior, p)) or self.adjacent(prior, p)):
            return p, 0.0
        for at in range(end - 2, max(-1, end - self.longest - 1), -1):
            p = window[at:]
            if p in known:
                prior = last[at] if at else before
                if prior is not None:
                    ok = fits.get((prior, p))
                    if ok or ok is None and self.adjacent(prior, p):
                        return p, 0.0
            if p not in tails:
                break
        return None, -np.inf

    def best_scored(self, window, last, best, before):
        end, choice, top = len(window), None, -np.inf
        for at in range(max(0, end - self.longest), end):
            p = window[at:]
            if p in self.id or at == end - 1:
                s = best[at] + (self.score[self.id[p]] if p in self.id else self.floor)
                if s > top:
                    choice, top = p, s
        return choice, top

    def converged(self, window: str, last: list[str], best: list[float]) -> int:
        """The furthest boundary that the paths of all open positions share, or 0.  Open are the end and
        what a piece that goes on beyond the end may begin at."""
        n = len(last) - 1
        at = {i for i in range(max(0, n - self.longest + 1), n) if best[i] > -np.inf and window[i:] in self.heads} | ({n} if best[n] > -np.inf else set())
        if not at:
            return 0
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - len(last[far]))
        return at.pop()

    def back(self, last: list[str], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids_of(self, p: str) -> list[int]:
        if p in self.id:
            return [self.id[p]]
        return [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]

    def _stretches(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each stretch), by the streaming search."""
        ids = [[i for part in self.stream(s.decode("utf-8")) for i in part] for s in stretches]
        return np.array([i for own in ids for i in own], self.kind), np.array([len(own) for own in ids], np.int64)

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(code points, whether all paths have a boundary before each)."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        char = np.where(code < 0x10000, self.char[np.minimum(code, 0xFFFF)], 0)
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.joins[char[:-1], char[1:]]
        if self.wide:  # pieces with characters beyond U+FFFF: no cut beside one
            far = code >= 0x10000
            cut[1:] &= ~(far[1:] | far[:-1])
        return code, cut

    def _normalised(self, text: str) -> Iterator[str]:
        """The normalised text in parts of about PORTION characters.  Where the normaliser does more than to
        replace spaces, the text is normalised as a whole first."""
        whole = text if self.plain or not text else self.lib.normalize(text)
        for at in range(0, len(whole), PORTION):
            part = whole[at : at + PORTION]
            yield (SPACE if at == 0 else "") + part.replace(" ", SPACE) if self.plain else part

    def portions(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, as they are committed: nothing but the open characters of a portion is held."""
        parts, window = self._normalised(text), ""
        while (part := next(parts, None)) is not None:
            window += part
            met = np.flatnonzero(self._edges(window)[1])
            if met[-1]:
                yield self._together([window[: met[-1]]])[0]
                window = window[met[-1] :]
            elif len(window) >= PORTION:
                rest = _Stretch(window, parts, lambda t: np.flatnonzero(self._edges(t)[1]))
                for own in self.stream(rest):
                    yield np.array(own, self.kind)
                window = rest.after
        if window:
            yield self._together([window])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        if sum(map(len, texts)) > 16 * PORTION:
            each = [np.concatenate([np.zeros(0, self.kind), *self.portions(t)]) for t in texts]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return self._together([self.lib.normalize(t) if t else "" for t in texts])

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all normalised texts one after another, how many each has)."""
        joined = "".join(texts)
        code, cut = self._edges(joined)
        if not len(code):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        first = np.concatenate([[0], ends[:-1]])
        cut[first[first < len(code)]] = True
        start = np.flatnonzero(cut)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)  # bytes of a character
        at = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        ids, count = self.memo.ids(data, at[start], at[np.append(start[1:], len(code))])
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(before[np.searchsorted(start, np.concatenate([[0], ends]))])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, U+2581 as a space; the first space is still there."""
        return self.pool[ranges(self.pool_at[ids], self.pool_size[ids])]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together, U+2581 to spaces, the first space taken off."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class _Stretch:
    """The characters of a window and of the parts after it, up to the next place where all paths have a
    boundary; what was read beyond it is in `after`."""

    def __init__(self, window: str, parts: Iterator[str], edges):
        self.window, self.parts, self.edges, self.after = window, parts, edges, ""

    def __iter__(self) -> Iterator[str]:
        yield from self.window
        before = self.window[-1]
        for part in self.parts:
            met = self.edges(before + part)
            end = int(met[1]) - 1 if len(met) > 1 else len(part)  # the first is the beginning
            yield from part[:end]
            if end < len(part):
                self.after = part[end:]
                return
            before = part[-1]


def pieces(path: str) -> Pieces:
    """The model that the tasks of a worker share, if they are lean(..., (("pieces", path),))."""
    return kept(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each whole text."""

    def run(batches):
        model = pieces(path)
        for b in slices(batches, "text"):
            ids, count = model.encode_all(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(lean(run, (("pieces", path),)), "doc_id long, ids array<int>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        model = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([model.decode(i or []) for i in some.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run, (("pieces", path),)), "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, same): what each whole text encodes to, and whether decoding the
    ids gives the text back."""
    def long_one(model, text):
        """(ids, their crc32, whether they spell the text) of a text in portions."""
        n, crc, at, same, first = 0, 0, 0, True, True
        for ids in model.portions(text):
            n, crc = n + len(ids), zlib.crc32(ids.astype("<u4"), crc)
            said = model.spelled(ids).tobytes().decode("utf-8", "replace")
            said = said[1:] if first and said.startswith(" ") else said
            same, at, first = same and text.startswith(said, at), at + len(said), False
        return n, crc, same and at == len(text)

    def run(batches):
        model = pieces(path)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            if len(texts) == 1 and len(texts[0]) > PORTION:
                columns = [[x] for x in long_one(model, texts[0])]
            else:
                ids, count = model.encode_all(texts)
                ends = np.cumsum(count)
                raw, full = model.spelled(ids), np.concatenate([[0], np.cumsum(model.pool_size[ids])])
                crc, same = [], []
                for t, a, z in zip(texts, ends - count, ends):
                    crc.append(zlib.crc32(ids[a:z].astype("<u4")))
                    back = raw[full[a] : full[z]].tobytes()
                    back = back[1:] if back.startswith(b" ") else back
                    same.append(back == t.encode("utf-8") or model.decode(ids[a:z].tolist()) == t)
                columns = [count, crc, same]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))]], names=["doc_id", "n_ids", "ids_crc32", "same"])

    return _texts(docs).mapInArrow(lean(run, (("pieces", path),)), "doc_id long, n_ids long, ids_crc32 long, same boolean")
