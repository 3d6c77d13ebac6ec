"""LM scoring with a probabilistic suffix tree over words.

States are contexts of up to ``depth`` words. A context is a candidate when it occurs
``min_count`` times in training, a number that doesn't depend on the size of the corpus,
so candidates grow with the input; it is retained when its next-word distribution
diverges from that of its parent (the context without its first word) by more than
what its description costs: sum of c(sx) * log(P(x|s) / P(x|parent)) over next words
x has to exceed half of T(s) * log c(s), T(s) the number of different next words. A
retained state's distribution is smoothed with its parent's by T(s):
(c(sx) + T(s) P(x|parent)) / (c(s) + T(s)); the root is (c(x)+0.5) / (N+0.5(V+1)).
A word is scored by its longest retained context.

All counts cover all training documents. Both the divergence and T(s) are sums over the
training positions that have the context, so a batch sums its own positions and a
shard adds up what batches sent: no state's distribution meets in one task. Shards number
words, and then the candidates of each length, by falling count. With these numbers a batch
holds its texts as a compact stream of words, and a context with its next word is
one exact number, of which a batch sends the steps in order.

Defined results: a null or empty text is one end token; texts may be of any length; a null doc_id counts as the
empty text for the split; rows with equal doc_id are counted and scored each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm import hashing as H

END = np.uint64(0xE7037ED1A0B428DB)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
WORDS, NEXT, GAINS = range(3)
#: Text in a batch; the larger it is, the fewer batches ask about the same words and contexts.
BATCH_BYTES = 8 << 20
#: Bits of a word's hash that are sent; others choose its shard.
WORD_BITS = np.uint64(16)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def tokens(table: pa.Table):
    """The token hashes of (doc_id, text) rows, the number of words a row, and which rows are held out."""
    tok, n_words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in X.slices(table.select(["doc_id", "text"]).to_batches(), 1 << 20):
        buf, offsets = H.flat(b.column(1), lower=True)
        start, end, row = H.word_spans(buf, offsets)
        n_words.append(np.bincount(row, minlength=b.num_rows))
        own = np.full(len(row) + b.num_rows, END)
        own[np.arange(len(row)) + row] = H.range_hash(buf, start, end)
        tok.append(own)
    return np.concatenate(tok), np.concatenate(n_words), np.array([held_out(x) for x in table.column("doc_id").to_pylist()], bool)


@dataclass
class Level:
    """The positions of a batch that have a candidate context of one length."""

    at: np.ndarray  #: positions of the next words
    count: np.ndarray  #: how often the context of each occurs in training
    context: np.ndarray  #: which of contexts it is
    contexts: np.ndarray  #: the numbers of the different contexts
    which: np.ndarray  #: the key (context and next word) of each position; -1 where the word isn't in training
    keys: np.ndarray
    order: np.ndarray  #: of the keys by shard, and the shards' bounds in it
    bounds: np.ndarray


class Stream:
    """The words of a batch as numbers of the whole corpus, and what is known of its contexts so far."""

    def __init__(self, arrays: list[np.ndarray], n_shards: int, min_count: int):
        ids, null, n_words, out, word, c, number, heads = arrays
        self.ids, self.n_words, self.out, self.n_shards, self.min_count = pa.array(ids, mask=null), n_words, out, n_shards, min_count
        self.word = _from_planes(word)
        self.c, self.number = _from_planes(c).astype(np.float64), X.load_sorted(number)
        self.total, kinds, width = heads
        self.width = np.uint64(width)
        self.row = np.repeat(np.arange(len(n_words)), n_words + 1)
        self.train = ~out[self.row]
        self.root = (self.c + 0.5) / (self.total + 0.5 * (kinds + 1))
        self.p = self.root[self.word]
        self.levels: list[Level] = []
        i = np.arange(1, len(self.word))
        at = i[(self.row[i] == self.row[i - 1]) & (self.c[self.word[i - 1]] >= min_count)]
        self._add(at, self.c[self.word[at - 1]], self.number[self.word[at - 1]])

    def _add(self, at: np.ndarray, count: np.ndarray, context: np.ndarray) -> None:
        x, n = self.number[self.word[at]], np.uint64(self.n_shards)
        known = np.flatnonzero(self.c[self.word[at]] > 0)
        # Of a context and a shard, the words that belong there differ by multiples of the number of shards.
        shard, code = (context + x)[known] % n, (context * self.width + x // n)[known]
        if not len(code) or int(code.max()) < (1 << 64) // self.n_shards - 1:
            both, inverse = np.unique(code * n + shard, return_inverse=True)
            shard, code = both % n, both // n
        else:
            order = np.lexsort((shard, code))
            new = np.r_[True, (code[order[1:]] != code[order[:-1]]) | (shard[order[1:]] != shard[order[:-1]])]
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            shard, code = shard[order[new]], code[order[new]]
        which = np.full(len(at), -1)
        which[known] = inverse
        contexts, mine = np.unique(context, return_inverse=True)
        self.levels.append(Level(at, count, mine, contexts, which, code, *X.by_shard(shard.astype(np.int64), self.n_shards)))

    def counted(self, counts: np.ndarray, numbers: np.ndarray) -> None:
        """Takes in the counts of the last level's keys, and the numbers of those that are candidates; goes a word deeper."""
        level = self.levels[-1]
        level.next = np.where(level.which >= 0, counts[level.which] if len(counts) else 0, 0).astype(np.float64)
        number = np.zeros(len(counts), np.uint64)
        number[counts >= self.min_count] = numbers
        at = level.at
        deeper = np.flatnonzero((level.next >= self.min_count) & (at + 1 < len(self.row)) & (self.row[np.minimum(at + 1, len(self.row) - 1)] == self.row[at]))
        self._add(at[deeper] + 1, level.next[deeper], number[level.which[deeper]])

    def still_needed(self, d: int, counts: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Counts of a level's keys, 0 for those whose context isn't retained and which are no candidates."""
        level = self.levels[d]
        use = counts >= self.min_count
        kept = np.flatnonzero((spread[level.context] > 0) & (level.which >= 0))
        use[level.which[kept]] = True
        return np.where(use, counts, 0)

    def gains(self, d: int):
        """For each context of a level: its divergence from the shorter one beyond what it costs, and T."""
        level = self.levels[d]
        own = np.flatnonzero(self.train[level.at])
        n, mine, following, count = len(level.contexts), level.context[own], level.next[own], level.count[own]
        spread = 1 / following
        gain = np.log(following / count / self.p[level.at[own]]) - 0.5 * spread * np.log(np.maximum(count, 2))
        return np.bincount(mine, gain, n).astype(np.float32), np.bincount(mine, spread, n).astype(np.float32)

    def retained(self, d: int, spread: np.ndarray) -> None:
        """Takes in T of each context of a level, 0 where it isn't retained: the level's probabilities."""
        level = self.levels[d]
        t, p = spread.astype(np.float64)[level.context], self.p[level.at]
        self.p[level.at] = np.where(t > 0, (level.next + t * p) / (level.count + t), p)


def _planes(x: np.ndarray) -> np.ndarray:
    """Whole numbers of up to 64 bits as byte planes, as many as the largest needs; their number comes first."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.r_[np.uint8(width), planes.T.ravel()]


def _from_planes(planes: np.ndarray) -> np.ndarray:
    body = planes[1:].reshape(int(planes[0]), -1)
    whole = np.zeros((body.shape[1], 8), np.uint8)
    whole[:, : len(body)] = body.T
    return whole.view(np.int64).ravel()


def _summed(key: list[np.ndarray], *values: list[np.ndarray]):
    """The distinct keys, where each key is among them, and the sums of the values."""
    known, which = np.unique(np.concatenate(key), return_inverse=True)
    return known, which, *(np.bincount(which, np.concatenate(v), len(known)) for v in values)


def _dump_ranks(count: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks of keys in order: by falling count, then key, they rise."""
    return X.dump_sorted(rank[np.argsort(-count.astype(np.int64), kind="stable")].astype(np.uint64))


def _load_ranks(count: np.ndarray, planes: np.ndarray) -> np.ndarray:
    rank = np.empty(len(count), np.uint64)
    rank[np.argsort(-count.astype(np.int64), kind="stable")] = X.load_sorted(planes)
    return rank


def _ranks(count: np.ndarray) -> np.ndarray:
    """0 for the largest count, and so on; ties in order."""
    rank = np.empty(len(count), np.uint32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
    return rank


def score(docs: DataFrame, min_count: int = 64, depth: int = 3) -> DataFrame:
    n_shards = X.shards(docs)
    packed = X.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), batch_bytes=BATCH_BYTES)

    def answer(bodies: list[bytes]) -> list[bytes]:
        kind = bodies[0][0]
        got = [X.load(b[1:], np.uint8, *((np.float32, np.float32) if kind == GAINS else (np.uint8,))) for b in bodies]
        key = [X.load_sorted(g[0]) for g in got]
        parts = np.cumsum([len(k) for k in key])[:-1]
        if kind == GAINS:
            _, which, gain, spread = _summed(key, [g[1] for g in got], [g[2] for g in got])
            t = np.where(gain > 0, np.rint(spread), 0)[which]  # T is a number of different words
            return [X.dump(_planes(x)) for x in np.split(t, parts)]
        _, which, total = _summed(key, [_from_planes(g[1]) for g in got])
        rank = np.zeros(len(total), np.uint32)
        numbered = total >= (min_count if kind == NEXT else 0)
        rank[numbered] = _ranks(total[numbered])
        head = [np.array([total.sum(), (total > 0).sum()])] if kind == WORDS else []
        out = []
        for own in np.split(which, parts):
            some = numbered[own]
            out.append(X.dump(*head, _planes(total[own]), _dump_ranks(total[own][some], rank[own][some])))
        return out

    # Every batch asks every shard about words, so it also learns N and V.
    def words(table: pa.Table):
        tok, n_words, out = tokens(table)
        known, which = np.unique(tok, return_inverse=True)
        n = np.bincount(which[~np.repeat(out, n_words + 1)], minlength=len(known)).astype(np.uint32)
        order, bounds = X.by_shard((H.mix(known & np.uint64((1 << int(WORD_BITS)) - 1)) % np.uint64(n_shards)).astype(np.int64), n_shards)
        for s in range(n_shards):
            own = order[bounds[s] : bounds[s + 1]]
            yield s, bytes([WORDS]) + X.dump(X.dump_sorted(known[own] >> WORD_BITS), _planes(n[own]))

    def repacked(left: pa.Table, right: pa.Table) -> pa.Table:
        """A batch as a stream of words by falling count."""
        table = X.unpack(left.column("body")[0].as_py())
        tok, n_words, out = tokens(table)
        known, which = np.unique(tok, return_inverse=True)
        order, bounds = X.by_shard((H.mix(known & np.uint64((1 << int(WORD_BITS)) - 1)) % np.uint64(n_shards)).astype(np.int64), n_shards)
        c, number, heads = np.zeros(len(known), np.int64), np.zeros(len(known), np.uint64), []
        for s, body in zip(right.column("shard").to_pylist(), right.column("body").to_pylist(), strict=True):
            own = order[bounds[s] : bounds[s + 1]]
            head, counts, ranks = X.load(body, np.float64, np.uint8, np.uint8)
            c[own] = _from_planes(counts)
            number[own] = _load_ranks(c[own], ranks) * np.uint64(n_shards) + np.uint64(s)
            heads.append(head)
        total, kinds = np.sum(heads, axis=0)
        by_number = np.argsort(number)
        place = np.empty(len(known), np.int64)
        place[by_number] = np.arange(len(known))
        ids = table.column("doc_id").combine_chunks()
        head = np.array([total, kinds, max(1, np.max(heads, axis=0)[1])])
        body = X.dump(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), n_words, out, _planes(place[which]), _planes(c[by_number]), X.dump_sorted(number[by_number]), head)
        return pa.Table.from_pydict({"batch": left.column("batch"), "body": pa.array([body], pa.binary())})

    def read(body: bytes) -> list[np.ndarray]:
        return X.load(body, np.int64, np.bool_, np.int64, np.bool_, np.uint8, np.uint8, np.uint8, np.float64)

    def stream(arrays: list[np.ndarray], replies: dict[int, bytes], rounds: int) -> tuple[Stream, list[np.ndarray]]:
        """A batch after so many rounds, and all that it has been told: for each round T of the contexts of the round before, counts of keys, and the numbers of candidates."""
        v, told = Stream(arrays, n_shards, min_count), []
        if X.KEPT in replies:
            told = [X.load_sorted(x) if i % 3 == 2 else _from_planes(x) for i, x in enumerate(X.load(replies[X.KEPT], *[np.uint8] * (3 * ((rounds - 1) // 2 * 2))))]
        for i in range(rounds):
            new = len(told) <= 3 * i
            if new:
                told.append(_spreads(replies, (2 * i + 1) * n_shards, n_shards, v.levels[i - 1]) if i else np.zeros(0, np.int64))
                told += _counts(replies, 2 * i * n_shards, n_shards, v.levels[i], min_count) if i < depth else []
            if i:
                v.retained(i - 1, told[3 * i])
                if new:
                    told[3 * i - 2] = v.still_needed(i - 1, told[3 * i - 2], told[3 * i])
            if i < depth:
                v.counted(told[3 * i + 1], told[3 * i + 2])
        return v, told

    def keeps(rounds: int) -> bool:
        """Every other round a batch sends itself what it still needs; between, older replies come again."""
        return rounds > 0 and rounds % 2 == 0

    def turn(rounds: int):
        """Round number rounds + 1: the keys of the next level, and the sums of the one before."""

        def ask(arrays: list[np.ndarray], replies: dict[int, bytes]):
            v, told = stream(arrays, replies, rounds)
            if keeps(rounds):
                yield X.KEPT, X.dump(*[X.dump_sorted(x) if i % 3 == 2 else _planes(x) for i, x in enumerate(told)])
            if rounds:
                level = v.levels[rounds - 1]
                gain, spread = v.gains(rounds - 1)
                order, bounds = _context_shards(level, n_shards)
                for s in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[s] : bounds[s + 1]]
                    yield (2 * rounds + 1) * n_shards + int(s), bytes([GAINS]) + X.dump(X.dump_sorted(level.contexts[own]), gain[own], spread[own])
            if rounds < depth:
                level = v.levels[rounds]
                own = v.train[level.at] & (level.which >= 0)
                n = np.bincount(level.which[own], minlength=len(level.keys)).astype(np.uint32)
                for s in np.flatnonzero(np.diff(level.bounds)):
                    keys = level.order[level.bounds[s] : level.bounds[s + 1]]
                    yield 2 * rounds * n_shards + int(s), bytes([NEXT]) + X.dump(X.dump_sorted(level.keys[keys]), _planes(n[keys]))

        return ask

    def settle(arrays: list[np.ndarray], replies: dict[int, bytes]) -> pa.Table:
        v, _ = stream(arrays, replies, depth + 1)
        n = len(v.n_words)
        columns = [v.ids, pa.array(v.out), pa.array(v.n_words + 1), pa.array(np.bincount(v.row, v.c[v.word] > 0, n).astype(np.int64)), pa.array(np.full(n, int(v.total))), pa.array(np.bincount(v.row, np.log10(v.root[v.word]), n)), pa.array(np.bincount(v.row, np.log10(v.p), n))]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    counts = X.answer(X.ask(packed, words), answer)
    streams = packed.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(repacked, X.PACKED).repartition("batch")
    first = turn(0)
    inbox = X.answer(X.ask(streams, lambda arrays: first(arrays, {}), read), answer)
    for rounds in range(1, depth + 1):
        mail = X.answer(X.ask_again(streams, inbox, turn(rounds), read), answer)
        inbox = mail if keeps(rounds) else inbox.unionByName(mail)
    return X.settle(streams, inbox, settle, SCHEMA, read)


def _context_shards(level: Level, n_shards: int):
    return X.by_shard((level.contexts % np.uint64(n_shards)).astype(np.int64), n_shards)


def _spreads(replies: dict[int, bytes], first: int, n_shards: int, level: Level) -> np.ndarray:
    """T of each context of a level, 0 where it isn't retained."""
    order, bounds = _context_shards(level, n_shards)
    out = np.zeros(len(level.contexts), np.int64)
    for s in np.flatnonzero(np.diff(bounds)):
        out[order[bounds[s] : bounds[s + 1]]] = _from_planes(X.load(replies[first + int(s)], np.uint8)[0])
    return out


def _counts(replies: dict[int, bytes], first: int, n_shards: int, level: Level, min_count: int) -> list[np.ndarray]:
    """The count of each key of a level, and the numbers of those that are candidates."""
    counts, numbers = np.zeros(len(level.keys), np.int64), np.zeros(len(level.keys), np.uint64)
    for s in np.flatnonzero(np.diff(level.bounds)):
        own = level.order[level.bounds[s] : level.bounds[s + 1]]
        body, ranks = X.load(replies[first + int(s)], np.uint8, np.uint8)
        counts[own] = _from_planes(body)
        some = own[counts[own] >= min_count]
        numbers[some] = _load_ranks(counts[some], ranks) * np.uint64(n_shards) + np.uint64(s)
    return [counts, numbers[counts >= min_count]]
