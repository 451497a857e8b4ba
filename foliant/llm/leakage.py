"""Evaluation texts inside a corpus: SimHash of item-sized windows with multi-index search.

The passages of an item are all its words and, so that it is found in part too, every run of `passage` words.
Each document gives windows of the same numbers of words at each of its words. Window and passage
get a 64-bit SimHash of their word shingles, weighted by letters. Fingerprints are cut into radius+1 blocks, and two
within `radius` bits agree in one block at least; so looking up every block of a window finds
all passages within the radius. Similar windows of few shingles can differ in many more bits, so a
second path looks for them exactly: of each passage the rarest shingles are kept, until the rest weighs
less than `least` of the whole. A window that shares none of them shares less than that and cannot be
similar enough, so the windows around each of them in a text are all that come into question. The
candidates of both are verified by the exact weighted Jaccard similarity of their shingles, and marked
exact if their words are the same in the same order.

A window can only be `least` similar to some passage if shingles that weigh `least` of it occur in passages of its length
at all; all other windows, nearly all of a corpus, are passed over before a fingerprint is made of them. That loses nothing.

Equal passages are one class, whoever has them. The classes are the query set: they are counted first and searched in blocks
of bounded size, one after another, and each block's broadcast is removed before the next is made. With more blocks
than one, the texts are read and cut into hashed words once and stored. Documents are never collected, joined or cut: windows run
over the whole text, and a long text is worked through in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.words import words
from foliant.plans.workspace import discard, store

_BITS = 64
#: Words worked on at once in a task.
PIECE = 64_000
#: Candidates compared at once.
CANDIDATES = 1_000_000
#: Pairs of shingles compared at once when candidates are verified.
SHINGLE_PAIRS = 8_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle of n words that starts at each word (as many as fit)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h, w = np.zeros(m, np.uint64), np.zeros(m, np.int32)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + m]
            w += weights[j : j + m]
        return _mix(h), w


def fingerprints(h: np.ndarray, w: np.ndarray, per: int, at: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the runs of `per` shingles that begin at the places `at`, or of all runs."""
    if at is None:
        at = np.arange(max(0, len(h) - per + 1))
    return _prints(_signs(h, w), per, at)


def _signs(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Running sums of the signed weights of each bit, one row more than shingles."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.zeros((len(h) + 1, _BITS), np.int32)
    np.cumsum((2 * bits - 1) * w[:, None], axis=0, out=total[1:])
    return total


def _prints(total: np.ndarray, per: int, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.uint64)
    return np.packbits(total[at + per] - total[at] > 0, axis=1).copy().view(np.uint64).ravel()


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of rows of shingles: sum of the smaller over sum of the larger total weights."""
    out = np.zeros(len(ha))
    own = lambda x, wx, y, wy: ((x[:, :, None] == y[:, None, :]) * wy[:, None, :]).sum(2)
    aa, ab = own(ha, wa, ha, wa), own(ha, wa, hb, wb)  # total weight of each of a's shingles in a, in b
    times = (ha[:, :, None] == ha[:, None, :]).sum(2)
    both = (np.minimum(aa, ab) / times).sum(1)
    union = wa.sum(1) + wb.sum(1) - both
    np.divide(both, union, out=out, where=union > 0)
    return out


def _cut(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def prefixes(sh: np.ndarray, sw: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, passage): the passages whose rarest shingles include key[i] are passage[start[i]:start[i + 1]].

    A window that has none of a passage's keys is less than `least` similar to it, for a `least` above 0.
    """
    if not len(sh):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    _, of, n = np.unique(sh, return_inverse=True, return_counts=True)
    order = np.lexsort((sh, n[of.reshape(sh.shape)]), axis=1)
    h, w = np.take_along_axis(sh, order, 1), np.take_along_axis(sw, order, 1)
    rest = w[:, ::-1].cumsum(1)[:, ::-1]  # weight of a shingle and those after it
    row, col = np.nonzero(rest >= least * rest[:, :1] - 1e-6)
    pairs = np.unique(np.rec.fromarrays([h[row, col], row], names="key,passage"))
    key, start = np.unique(pairs["key"], return_index=True)
    return key, np.append(start, len(pairs)), pairs["passage"].astype(np.int64)


def passage_index(length: int, classes: np.ndarray, hashes: np.ndarray, weights: np.ndarray, shingle: int, radius: int, least: float = 0.8) -> dict:
    """Passages of one length with their fingerprints, sorted by each block, and their rarest shingles; plain data, to be broadcast."""
    n = min(shingle, length)
    each = [shingles(h, w, n) for h, w in zip(hashes, weights)]
    prints = np.concatenate([fingerprints(h, w, length - n + 1) for h, w in each])
    edges = [round(i * _BITS / (radius + 1)) for i in range(radius + 2)]
    blocks = []
    for lo, hi in zip(edges, edges[1:]):
        key = _cut(prints, lo, hi)
        order = np.argsort(key, kind="stable")
        # where each value of a block of up to 20 bits begins among the sorted ones
        table = np.searchsorted(key[order], np.arange((1 << (hi - lo)) + 1, dtype=np.uint64)) if hi - lo <= 20 else None
        blocks.append((lo, hi, key[order], order, table))
    sh, sw = np.array([h for h, _ in each]), np.array([w for _, w in each], dtype=np.int64)
    return {
        "length": length, "classes": classes, "keys": np.unique(sh), "hashes": hashes, "n": n, "per": length - n + 1, "radius": radius, "least": least,
        "sh": sh, "sw": sw, "prints": prints, "blocks": blocks, "prefixes": prefixes(sh, sw, least),
    }


def _runs(a: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, place) of the n[i] places from a[i] on. Many places may belong to a common value: they are given about CANDIDATES at a time."""
    hit = np.flatnonzero(n)
    upto = np.cumsum(n[hit])
    for at in np.split(hit, np.searchsorted(upto, np.arange(CANDIDATES, upto[-1] if len(upto) else 0, CANDIDATES))):
        if len(at):
            off = np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            yield np.repeat(at, n[at]), np.repeat(a[at], n[at]) + off


def search(index: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, passage) of all pairs within the radius."""
    found = []
    for lo, hi, key, order, table in index["blocks"]:
        k = _cut(prints, lo, hi)
        if table is None:
            a, b = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
        else:
            a, b = table[k.astype(np.int64)], table[k.astype(np.int64) + 1]
        for win, place in _runs(a, b - a):
            pas = order[place]
            near = np.bitwise_count(prints[win] ^ index["prints"][pas]) <= index["radius"]
            found.append(np.stack([win[near], pas[near]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, p = np.unique(np.concatenate(found, axis=1), axis=1)
    return w, p


def sharing(index: dict, sh: np.ndarray, sw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, passage) of the pairs that share one of the passage's rarest shingles and whose weights allow `least`; starts tells where windows begin."""
    key, start, pas = index["prefixes"]
    if not len(key):
        return
    k = np.minimum(np.searchsorted(key, sh), len(key) - 1)
    hit = np.flatnonzero(key[k] == sh)
    win = (hit[:, None] - np.arange(index["per"])).ravel()
    k = np.repeat(k[hit], index["per"])
    ok = (win >= 0) & (win < len(starts))
    ok[ok] = starts[win[ok]]
    win, k = np.divmod(np.unique(win[ok] * len(key) + k[ok]), len(key))
    total = np.concatenate([[0], np.cumsum(sw, dtype=np.int64)])
    weight, own = total[win + index["per"]] - total[win], index["sw"].sum(1)
    for i, place in _runs(start[k], start[k + 1] - start[k]):
        p = pas[place]
        near = np.minimum(weight[i], own[p]) >= index["least"] * np.maximum(weight[i], own[p]) - 1e-6
        yield win[i[near]], p[near]


def verified(index: dict, sh: np.ndarray, sw: np.ndarray, win: np.ndarray, pas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, passage, similarity) of the pairs that are at least `least` similar, each once."""
    win, pas = np.divmod(np.unique(win * len(index["sh"]) + pas), len(index["sh"]))
    sim, per = np.zeros(len(win)), index["per"]
    step = max(1, SHINGLE_PAIRS // per**2)
    for a in range(0, len(win), step):
        cols, p = win[a : a + step, None] + np.arange(per), pas[a : a + step]
        sim[a : a + step] = similarity(sh[cols], sw[cols].astype(np.int64), index["sh"][p], index["sw"][p])
    ok = sim >= index["least"]
    return win[ok], pas[ok], sim[ok]


def passages(items: DataFrame, item_id: str, text: str, passage: int) -> DataFrame:
    """item_id, ws: all words of an item and every run of `passage` words of a longer one; none for an item without words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[item_id], pdf[text]):
                if ws := words(t):
                    rows += [(i, ws), *((i, ws[j : j + passage]) for j in range(len(ws) - passage + 1) if len(ws) > passage)]
            yield pd.DataFrame(rows, columns=["item_id", "ws"])

    return items.select(F.col(item_id).cast("bigint").alias(item_id), text).filter(F.col(item_id).isNotNull()).mapInPandas(cut, "item_id bigint, ws array<string>")


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _index(rows: pd.DataFrame, shingle: int, radius: int, least: float) -> list[tuple[int, np.ndarray, list[dict]]]:
    """(words in a shingle, all shingles, passages of each length) of classes (cls, ws)."""
    by_size: dict[int, list[dict]] = {}
    for length, g in rows.groupby(rows["ws"].map(len)):
        hs = np.array([[_hash(w) for w in ws] for ws in g["ws"]], dtype=np.uint64)
        wt = np.array([[len(w) for w in ws] for ws in g["ws"]], dtype=np.int32)
        x = passage_index(int(length), g["cls"].to_numpy(), hs, wt, shingle, radius, least)
        by_size.setdefault(x["n"], []).append(x)
    out = []
    for n, xs in sorted(by_size.items()):
        keys = np.unique(np.concatenate([x["keys"] for x in xs]))
        for x in xs:  # which of all shingles passages of this length hold; the last place stands for none
            x["held"] = np.append(np.isin(keys, x["keys"]), False)
        out.append((n, keys, xs))
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage: int = 12, shingle: int = 5, radius: int = 3, least: float = 0.8, block: int = 50_000) -> DataFrame:
    """doc_id, item_id, n_windows, similarity, exact: documents that hold an item or a passage of it.

    A pair is given if some window of the document is at least `least` (above 0) similar to a passage, however many bits
    their SimHashes differ in; similarity is the largest, exact tells whether some window has the same words in the same
    order, n_windows counts the pairs of such a window and a passage, each once. Null or empty texts hold nothing; null ids are left
    aside; rows that repeat a doc_id count as further texts of one document. Words of letters and digits count without case, accents,
    invisible and compatibility characters. `block` is the number of different passages searched at once.
    """
    spark = documents.sparkSession
    cut = store(passages(items, item_id, text, passage), "passages")
    classes = store(cut.select("ws").distinct().withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = cut.join(classes, "ws").groupBy("cls", "item_id").agg(F.count(F.lit(1)).alias("n_parts"))
    passes = -(-classes.count() // block)
    texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    source = texts if passes <= 1 else store(texts.mapInArrow(_hashed, "doc_id bigint, hs array<bigint>, ws array<int>"), "hashed")
    hits = spark.createDataFrame([], HITS)
    for p in range(passes):
        index = _index(classes.filter(F.pmod(F.xxhash64("cls"), F.lit(passes)) == p).toPandas(), shingle, radius, least)
        if not index:
            continue
        known = spark.sparkContext.broadcast(index)
        found = store(source.mapInArrow(_searcher(known), HITS), "hits")
        known.destroy()
        hits = hits.unionByName(found)
    if source is not texts:
        discard(source)
    pairs = hits.join(members, "cls").groupBy("doc_id", "item_id")
    return pairs.agg(F.sum(F.col("n_windows") * F.col("n_parts")).alias("n_windows"), F.max("similarity").alias("similarity"), F.bool_or("exact").alias("exact"))


HITS = "doc_id bigint, cls bigint, n_windows bigint, similarity double, exact boolean"


def _word_hashes(texts: pa.Array, seen: dict[str, tuple[int, int]]) -> Iterator[tuple[list[int], list[int]]]:
    """Hashes and numbers of letters of the words of each text."""
    for t in texts:
        hs, ws = [], []
        for word in words(t.as_py()):
            if (x := seen.get(word)) is None:
                if len(seen) > 500_000:
                    seen.clear()
                x = seen[word] = (_hash(word), len(word))
            hs.append(x[0])
            ws.append(x[1])
        yield hs, ws


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, tuple[int, int]] = {}
    for b in batches:
        hs, ws = zip(*_word_hashes(b.column(1), seen)) if b.num_rows else ((), ())
        signed = pa.array([np.array(h, np.uint64).view(np.int64) for h in hs], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), signed, pa.array(ws, pa.list_(pa.int32()))], names=["doc_id", "hs", "ws"])


def _reach(cols: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many words from each of some places on lie in one document and in an unbroken run of the shingles of n words that begin at these places."""
    breaks = np.flatnonzero(np.diff(cols) != 1)
    ends = np.append(cols[breaks] + n, cols[-1] + n)  # the word after the last shingle of each run
    run = ends[np.searchsorted(breaks, np.arange(len(cols)), "left")]
    return np.minimum(run, np.searchsorted(doc, doc[cols], "right")) - cols


def _live(x: dict, known: np.ndarray, sw: np.ndarray, total: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which windows of a length begin at each of some shingles that reach far enough and may be similar enough to a passage by what their known shingles weigh."""
    per = x["per"]
    m = len(reach) - per + 1
    if m <= 0 or not known.any():
        return np.zeros(0, bool)
    some = np.zeros(len(total), np.int64)
    np.cumsum(np.where(known, sw, 0), out=some[1:])
    return (reach[:m] >= x["length"]) & (some[per:] - some[:-per] >= x["least"] * (total[per:] - total[:-per]) - 1e-6)


def _searcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, int]] = {}
        longest = max(x["length"] for _, _, xs in index.value for x in xs)
        size = max(PIECE, 4 * longest)

        def piece(h: np.ndarray, w: np.ndarray, doc: np.ndarray, ids: np.ndarray, until: int) -> Iterator[pd.DataFrame]:
            for n, keys, xs in index.value:
                sh, sw = shingles(h, w, n)
                if not len(sh):
                    continue
                place = np.minimum(np.searchsorted(keys, sh), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == sh)
                if not len(hit):
                    continue
                # only what lies near a known shingle is looked at further
                far = max(x["per"] for x in xs) - 1
                edge = np.bincount(np.maximum(hit - far, 0), minlength=len(sh) + 1) - np.bincount(np.minimum(hit + far + 1, len(sh)), minlength=len(sh) + 1)
                cols = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                sh, sw = sh[cols], sw[cols]
                place = np.where(keys[place[cols]] == sh, place[cols], len(keys))
                total = np.concatenate([[0], np.cumsum(sw, dtype=np.int64)])
                reach = np.where(cols < until, _reach(cols, doc, n), 0)
                lives = [(x, live, np.flatnonzero(live)) for x in xs if (live := _live(x, x["held"][place], sw, total, reach)).any()]
                # running sums of bits are made for the shingles of these windows only
                edge = np.zeros(len(cols) + 1, np.int64)
                for x, _, at in lives:
                    edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + x["per"], minlength=len(edge))
                need = np.cumsum(edge[:-1]) > 0
                signs, moved = _signs(sh[need], sw[need]), np.cumsum(need) - need
                for x, live, at in lives:
                    win, pas = search(x, _prints(signs, x["per"], moved[at]))
                    found = [verified(x, sh, sw, *c) for c in chain([(at[win], pas)], sharing(x, sh, sw, live))]
                    at, pas, sim = (np.concatenate(c) for c in zip(*found))
                    _, one = np.unique(at * len(x["sh"]) + pas, return_index=True)
                    at, pas, sim = cols[at[one]], pas[one], sim[one]
                    same = (h[at[:, None] + np.arange(x["length"])] == x["hashes"][pas]).all(1)
                    yield pd.DataFrame({"doc_id": ids[doc[at]], "cls": x["classes"][pas], "n_windows": 1, "similarity": sim, "exact": same})

        def flush(hs: list, ws: list, doc: list, ids: list) -> Iterator[pa.RecordBatch]:
            h, w, d, i = np.array(hs, np.uint64), np.array(ws, np.int32), np.array(doc, np.int64), np.array(ids, np.int64)
            step = size - longest + 1
            for a in range(0, max(1, len(h) - longest + 1), step):
                # windows that begin in the overlap belong to the next piece, if there is one
                until = step if a + step < len(h) - longest + 1 else size
                for out in piece(h[a : a + size], w[a : a + size], d[a : a + size], i, until):
                    if len(out):
                        out = out.groupby(["doc_id", "cls"], as_index=False).agg({"n_windows": "sum", "similarity": "max", "exact": "max"})
                        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        for b in batches:
            hs, ws, doc, ids = [], [], [], []
            made = _word_hashes(b.column(1), seen) if b.num_columns == 2 else ((np.array(x.as_py(), np.int64).view(np.uint64).tolist(), y.as_py()) for x, y in zip(b.column(1), b.column(2)))
            for k, (x, y) in zip(b.column(0).to_pylist(), made):
                hs += x
                ws += y
                doc += [len(ids)] * len(x)
                ids.append(k)
                if len(hs) >= size:
                    yield from flush(hs, ws, doc, ids)
                    hs, ws, doc, ids = [], [], [], []
            yield from flush(hs, ws, doc, ids)

    return run
