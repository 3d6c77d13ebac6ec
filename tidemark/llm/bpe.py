"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut at word starts where a rolling hash of the two words before hits a
mask, so equal passages give equal chunks wherever they stand. Shards find the
chunks that occur more than once in the corpus; the text of such a chunk goes to
one shard, which encodes it once for all documents. Other chunks are encoded
where they are. Each join of two chunks is then checked: the words on both sides
are encoded together, and where that disagrees with the ids at the join, the two
chunks are merged and encoded again until the join agrees. All this needs a tokenizer whose
pre-tokens end at white space, which is checked on its file; with another one, texts are encoded whole.

Defined results: a null or empty text has no ids and decodes to the empty text;
texts may be of any length; an empty table gives no rows; rows with equal keys are encoded each; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm import hashing as H

#: A cut every so many words on average.
MEAN_WORDS = 48
#: Words whose ids a worker keeps, at most.
MEMO_WORDS = 500_000
#: Words that are encoded in one call of the library.
JOINED = 64
SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, decoded string"


class Codec:
    """The library's tokenizer with a bounded memo of the ids of words.

    encode() is only right where the tokenizer file shows that white space ends every pre-token:
    then the ids of a text are those of its words in order, and each different word is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.lib.id_to_token(i) for i in range(size)]
        self.joined = self.lib.decoder is None  # then decode() joins the tokens by a space
        # the memo: hashes of words in order, a second hash, when each was last used, and where its ids are
        self.hash, self.check, self.used = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids, self.clock = np.zeros(1, np.int64), np.zeros(0, "<u4"), 0

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text by the library, as packed unsigned 32-bit integers."""
        ids, n = self._library(texts)
        return _cut(ids.tobytes(), 4 * n)

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], []
        for a in range(0, len(texts), 2048):  # so many at a time that the library's own objects stay few
            got = [e.ids for e in self.lib.encode_batch_fast([t.decode() for t in texts[a : a + 2048]], add_special_tokens=False)]
            n += map(len, got)
            ids.append(np.fromiter(itertools.chain.from_iterable(got), "<u4"))
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.array(n, np.int64)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _library for words, JOINED of them in one text; where a token doesn't lie in one word, that text's words alone."""
        ids, n = [], []
        for a in range(0, len(words), 2048):
            groups = [[w.decode() for w in words[b : b + JOINED]] for b in range(a, min(a + 2048, len(words)), JOINED)]
            for group, e in zip(groups, self.lib.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                size = np.array([len(w) for w in group])
                begin = np.cumsum(size + 1) - size - 1
                span = np.fromiter(itertools.chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)
                word = np.searchsorted(begin, span[:, 0], side="right") - 1
                if (span[:, 1] > begin[word] + size[word]).any() or (np.diff(word) < 0).any():
                    own, count = self._library([w.encode() for w in group])
                else:
                    own, count = np.array(e.ids, "<u4"), np.bincount(word, minlength=len(group))
                ids.append(own)
                n.append(count)
        return np.concatenate(ids or [np.zeros(0, "<u4")]), np.concatenate(n or [np.zeros(0, np.int64)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """As whole(), through the memo."""
        data = b"".join(texts)
        buf, offsets = np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        start, end, row = H.word_spans(buf, offsets)
        h, check = H.range_hash(buf, start, end), H.range_hash(buf, start, end, 1)
        every, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (check[first][which] != check).any():  # two words of one hash
            return self.whole(texts)
        check, self.clock = check[first], self.clock + 1
        place = np.minimum(np.searchsorted(self.hash, every), max(len(self.hash) - 1, 0))
        known = (self.hash[place] == every) & (self.check[place] == check) if len(self.hash) else np.zeros(len(every), bool)
        ids, n = self._words([data[a:b] for a, b in zip(start[first[~known]].tolist(), end[first[~known]].tolist(), strict=True)])
        begin, size = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
        begin[known], size[known] = self.at[place[known]], np.diff(self.at)[place[known]]
        begin[~known], size[~known] = len(self.ids) + np.cumsum(n) - n, n
        self.used[place[known]] = self.clock
        ids = np.concatenate([self.ids, ids])
        length = size[which]
        total = np.cumsum(length)
        out = ids[np.repeat(begin[which] - total + length, length) + np.arange(length.sum())]
        self._keep(np.r_[self.hash, every[~known]], np.r_[self.check, check[~known]], np.r_[self.used, np.full(len(n), self.clock)], np.r_[np.diff(self.at), n], ids)
        return _cut(out.tobytes(), 4 * np.bincount(row, length, len(texts)).astype(np.int64))

    def _keep(self, hashes: np.ndarray, check: np.ndarray, used: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        order = order[np.r_[True, hashes[order[1:]] != hashes[order[:-1]]][: len(order)]]
        if len(order) > MEMO_WORDS:  # the half that was used last stays
            order = order[used[order] >= np.partition(used[order], len(order) // 2)[len(order) // 2]]
            order = order[-MEMO_WORDS:]
        begin = np.cumsum(n) - n
        size = n[order]
        self.hash, self.check, self.used, self.at = hashes[order], check[order], used[order], np.r_[0, np.cumsum(size)]
        self.ids = ids[np.repeat(begin[order] - self.at[:-1], size) + np.arange(self.at[-1])]

    def decode(self, ids: np.ndarray) -> str:
        if self.joined:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.lib.decode(ids.tolist(), skip_special_tokens=False)


#: One character of each kind that patterns of pre-tokenizers tell apart, and endings of contractions.
PROBES = ["a", "A", "é", "日", "7", "½", "_", "-", "'", ".", "!", "§", "€", "\u0301", "s", "re", "<|", "##"]


def splits_at_space(tokenizer: dict) -> bool:
    """Whether a tokenizer file shows that no pre-token and no added token spans white space.

    A splitting step has to be of a kind that always does so, or to drop all that its pattern doesn't
    match, with a pattern that never matches across white space between any two of PROBES.
    """
    import regex

    def step(x: dict | None) -> bool:
        if not x:
            return False
        if x["type"] == "Sequence":
            return any(map(step, x["pretokenizers"]))
        if x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
            return True
        if x["type"] != "Split" or x["behavior"] != "Removed" or not x["invert"] or "Regex" not in x["pattern"]:
            return False
        pattern = regex.compile(x["pattern"]["Regex"])
        texts = (f"{a}{gap}{b}" for a in PROBES for b in PROBES for gap in (" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \n"))
        return not any(regex.search(r"\s", m[0]) for t in texts for m in pattern.finditer(t))

    def harmless(x: dict | None) -> bool:
        """A normaliser that leaves white space white space."""
        if not x:
            return True
        if x["type"] == "Sequence":
            return all(map(harmless, x["normalizers"]))
        return x["type"] in ("NFC", "NFD", "Lowercase") or (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " ")

    added = [x["content"] for x in tokenizer.get("added_tokens", [])]
    return step(tokenizer.get("pre_tokenizer")) and harmless(tokenizer.get("normalizer")) and not any(regex.search(r"\s", x) for x in added)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(table: pa.Table, mean_words: int):
    """Bytes, chunk bounds, the document of each chunk, and the chunks' hashes."""
    buf, offsets = H.flat(table.column("text"))
    start, end, doc = H.word_spans(buf, offsets)
    prefix = H.prefix_hashes(buf)
    cut = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    if len(doc) > 2:
        pair = H.range_hash(H.hash_of(prefix, start, end), np.arange(len(doc) - 2), np.arange(2, len(doc)))
        cut[2:] |= (pair % np.uint64(mean_words) == 0) & (doc[2:] == doc[:-2])
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(doc)] - 1
    begin, stop = start[first], end[last] if len(first) else start[first]
    return buf, begin, stop, doc[first], H.hash_of(prefix, begin, stop), (start, end, first, last)


def _distinct(h: np.ndarray, n_shards: int):
    """Distinct chunks by hash: one place of each, which one each chunk is, how often, and the shard. A shard only says which hashes occur again; texts decide."""
    every, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return at, inverse, count, (every % np.uint64(n_shards)).astype(np.int64)


def _cut(body: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [body[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def encode_decode(docs: DataFrame, tokenizer: str, mean_words: int = MEAN_WORDS, keep: bool = True, keep_decoded: bool = True) -> DataFrame:
    """Per document: ids (packed unsigned 32-bit, little-endian), decoded text, and the SHA-256 of both; ids and decoded text are null where they aren't kept."""
    n_shards = X.shards(docs)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    def rows_of(keys: list, encoded: list[bytes]) -> pa.Table:
        rows, own_codec = [], codec(tokenizer)
        for key, ids in zip(keys, encoded, strict=True):
            decoded = own_codec.decode(np.frombuffer(ids, "<u4"))
            rows.append((key, len(ids) // 4, ids if keep else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded if keep_decoded else None))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names)

    def whole_texts(batches):
        for b in X.slices(batches):
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            yield from rows_of(b.column(0).to_pylist(), codec(tokenizer).whole([t.encode() for t in texts])).to_batches()

    if not splits_at_space(json.loads(Path(tokenizer).read_text())):  # then chunks needn't encode alone as they do together
        return docs.mapInArrow(whole_texts, SCHEMA)
    packed = X.pack(docs)

    def ask(table: pa.Table):
        buf, begin, stop, _, h, _ = chunks(table, mean_words)
        at, _, count, shard = _distinct(h, n_shards)
        order, bounds = X.by_shard(shard, n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            yield int(s), X.dump(h[at[own]], np.packbits(count[own] > 1))

    def shared(bodies: list[bytes]) -> list[bytes | None]:
        got = [X.load(b, np.uint64, np.uint8) for b in bodies]
        h = np.concatenate([g[0] for g in got])
        times = np.concatenate([np.unpackbits(g[1])[: len(g[0])] for g in got]).astype(np.int64) + 1
        _, inverse = np.unique(h, return_inverse=True)
        many = (np.bincount(inverse, times) > 1)[inverse]
        return [X.dump(np.packbits(m)) if m.any() else None for m in np.split(many, np.cumsum([len(g[0]) for g in got])[:-1])]

    def send_text(table: pa.Table, replies: dict[int, bytes]):
        buf, begin, stop, _, h, _ = chunks(table, mean_words)
        at, _, _, shard = _distinct(h, n_shards)
        order, bounds = X.by_shard(shard, n_shards)
        raw = buf.tobytes()
        for s, body in replies.items():
            own = order[bounds[s] : bounds[s + 1]]
            own = own[np.unpackbits(X.load(body, np.uint8)[0])[: len(own)] > 0]
            texts = [raw[begin[i] : stop[i]] for i in at[own]]
            yield s, X.dump(own.astype(np.uint32), np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8))

    def encode_once(bodies: list[bytes]) -> list[bytes | None]:
        asked = []
        for b in bodies:
            own, lengths, data = X.load(b, np.uint32, np.uint32, np.uint8)
            asked.append((own, _cut(data.tobytes(), lengths)))
        texts = list(dict.fromkeys(t for _, ts in asked for t in ts))
        ids = dict(zip(texts, codec(tokenizer).encode(texts), strict=True))
        out = []
        for own, ts in asked:
            got = [ids[t] for t in ts]
            out.append(X.dump(own, np.array([len(g) for g in got], np.uint32), np.frombuffer(b"".join(got), np.uint8)))
        return out

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        buf, begin, stop, doc, h, words = chunks(table, mean_words)
        at, inverse, _, _ = _distinct(h, n_shards)
        raw, own_codec = buf.tobytes(), codec(tokenizer)
        ids: list[bytes | None] = [None] * len(at)
        for body in replies.values():
            own, lengths, data = X.load(body, np.uint32, np.uint32, np.uint8)
            for i, x in zip(own.tolist(), _cut(data.tobytes(), lengths), strict=True):
                ids[i] = x
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, own_codec.encode([raw[begin[at[i]] : stop[at[i]]] for i in rest]), strict=True):
            ids[i] = x
        bad = _bad_joins(own_codec, raw, doc, [ids[i] for i in inverse.tolist()], words)
        bounds = np.searchsorted(doc, np.arange(table.num_rows + 1)).tolist()
        order = inverse.tolist()
        encoded = []
        for r in range(table.num_rows):
            a, b = bounds[r], bounds[r + 1]
            parts = [ids[i] for i in order[a:b]]
            if not bad.isdisjoint(range(a, b)):
                parts = _repair(own_codec, raw, begin[a:b], stop[a:b], parts, words, a)
            encoded.append(b"".join(parts))
        return rows_of(table.column("doc_id").to_pylist(), encoded)

    known = X.answer(X.ask(packed, ask), shared)
    encoded = X.answer(X.ask_again(packed, known, send_text), encode_once)
    return X.settle(packed, encoded, settle, SCHEMA)


def _agrees(left: bytes, right: bytes, both: bytes) -> bool:
    """Whether the ids around a join are those of both sides encoded together, wherever the join falls in them."""
    return any(left.endswith(both[:i]) and right.startswith(both[i:]) for i in range(0, len(both) + 1, 4))


def _bad_joins(own: Codec, raw: bytes, doc: np.ndarray, ids: list[bytes], words) -> set[int]:
    """Chunks whose join with the next one disagrees with the encoding of the words around it."""
    start, end, first, last = words
    joins = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    around = [raw[a:b] for a, b in zip(start[last[joins]].tolist(), end[first[joins + 1]].tolist(), strict=True)]
    both = own.whole(around)
    return {j for j, x in zip(joins.tolist(), both, strict=True) if not (x.startswith(ids[j][-4:]) and ids[j + 1].startswith(x[4:])) and not _agrees(ids[j], ids[j + 1], x)}


def _repair(own: Codec, raw: bytes, begin, stop, parts: list[bytes], words, base: int) -> list[bytes]:
    """Merges chunks over a disagreeing join and encodes them again, until every join agrees."""
    start, end, first, last = words
    runs = [[i, i] for i in range(len(parts))]
    parts = list(parts)
    j = 0
    while j + 1 < len(runs):
        around = raw[start[last[base + runs[j][1]]] : end[first[base + runs[j + 1][0]]]]
        if _agrees(parts[j], parts[j + 1], own.whole([around])[0]):
            j += 1
            continue
        runs[j : j + 2] = [[runs[j][0], runs[j + 1][1]]]
        parts[j : j + 2] = own.whole([raw[begin[runs[j][0]] : stop[runs[j][1]]]])
        j = max(0, j - 1)
    return parts
