"""Subject areas of documents: distributed latent Dirichlet allocation.

A topic model is fitted to all documents: a topic for each subject and language, started from the words that
its hand-labelled documents prefer, and some background topics for each language. Each pass works out the topic
proportions of every document (in the tasks, by the zero-order collapsed update, and with the topics of its
language only, unless it mixes languages) and adds up the topic-word counts; only those, a table of vocabulary x topics, come together. Hand labels raise the
prior of their subjects in their documents and no more, so wrong ones are outvoted. The fitted topics are mapped to
subjects by their top terms: a topic stands for the subject that its terms prefer, or for none.

A document deals with a subject if its topic proportions give the subject as many words as `least` sentences need and at
least `least` of its sentences are about it. The proportions of the document are the prior for each of its sentences,
and a sentence is about a subject if enough of its words fall to topics of that subject; words that the subject's topics have no more
often than the others count for nothing, which the fitted topics tell and not the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.words import plain
from foliant.plans.workspace import small, store


@dataclass(frozen=True)
class Settings:
    """Parameters of the model; shares are of all documents, so that they mean the same at any size."""

    background: int = 2  #: topics for each language besides those of the subjects
    language_share: float = 0.01  #: a language has topics of its own if at least this share of the documents is marked with it
    tolerance: float = 0.01  #: passes end when less than this share of all words has changed its topic
    most_passes: int = 100  #: the end of a fit that does not settle; the test data settle in 10 to 20
    inner: int = 8
    alpha: float = 0.15
    beta: float = 0.02
    label_prior: float = 2.0
    rarest: float = 5e-4  #: a word in fewer documents than this share has no entry of its own; so the vocabulary is bounded by words per document / rarest
    buckets: int = 1_024  #: entries that the rarer words share by their hashes, so that every word takes part
    pure: float = 0.9  #: a text of whose words this share is of one language is explained by the topics of that language, another by all
    top_terms: int = 40
    preference: float = 2.0  #: a word speaks fully for a subject if it is exp(2) times as frequent in the subject's topics as in the others
    mass: float = 2.5  #: words of a sentence that must fall to a subject
    seed: int = 42


#: Names of languages by their three-letter codes.
LANGUAGES = {"eng": "en", "spa": "es", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}


def language_key(x: Column | str) -> Column:
    """The two-letter code of a language however it is written (en, EN, en-GB, eng); null for null or blanks."""
    code = F.regexp_extract(F.lower(F.col(x) if isinstance(x, str) else x), "^[^a-z]*([a-z]*)", 1)
    short = F.create_map(*(F.lit(v) for kv in LANGUAGES.items() for v in kv))
    return F.nullif(F.coalesce(F.try_element_at(short, code), F.substring(code, 1, 2)), F.lit(""))


def sentence_words(text: str | None) -> list[list[str]]:
    """The words of two letters or more of each sentence, without markup, case, accents and numbers."""
    if not text:
        return []
    text = re.sub(r"<[^<>]*>", " ", plain(text))
    out = [re.findall(r"[^\W\d_]{2,}", s) for s in re.split(r"[.!?]+(?=\s|$)|\n\s*\n|(?<=[.!?>])\n", text)]
    return [s for s in out if s]


def _sentences(documents: DataFrame) -> DataFrame:
    """doc_id, hs, lens, lang, new_h, new_w: the hashed words of each document, the words of each of its sentences, and the words that its task had not met before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            hs, lens, new_h, new_w = [], [], [], []
            for t in b.column(1):
                sentences = sentence_words(t.as_py())
                row, fresh = [], []
                for ws in sentences:
                    for w in ws:
                        if (h := seen.get(w)) is None:
                            if len(seen) > 1_000_000:
                                seen.clear()
                            h = xxhash.xxh3_64_intdigest(w)
                            seen[w] = h = h - (1 << 64) if h >> 63 else h
                            fresh.append((h, w))
                        row.append(h)
                hs.append(row)
                lens.append([len(ws) for ws in sentences])
                new_h.append([h for h, _ in fresh])
                new_w.append([w for _, w in fresh])
            lists = [pa.array(hs, pa.list_(pa.int64())), pa.array(lens, pa.list_(pa.int32())), b.column(2), pa.array(new_h, pa.list_(pa.int64())), pa.array(new_w, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "hs", "lens", "lang", "new_h", "new_w"])

    return documents.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id bigint, hs array<bigint>, lens array<int>, lang string, new_h array<bigint>, new_w array<string>")


def _frequencies(cut: DataFrame) -> DataFrame:
    """h, n: the number of documents that hold a word."""
    return cut.select(F.explode(F.array_distinct("hs")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def _encode(docs: DataFrame, hashes: np.ndarray, buckets: int) -> DataFrame:
    """doc_id, ids, lens, labels, lang: the words by their place in the vocabulary, others by that of their bucket after it. hashes are those of the vocabulary in its order."""
    order = np.argsort(hashes, kind="stable")
    known = docs.sparkSession.sparkContext.broadcast((hashes[order], order.astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place = known.value
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = (len(key) + x.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            if len(key):
                at = np.minimum(np.searchsorted(key, x), len(key) - 1)
                ids = np.where(key[at] == x, place[at], ids)
            ends = np.concatenate([[0], np.cumsum(_sizes(b.column(1)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), *(b.column(i) for i in (2, 3, 4))], names=["doc_id", "ids", "lens", "labels", "lang"])

    return docs.mapInArrow(encode, "doc_id bigint, ids array<int>, lens array<int>, labels array<int>, lang int")


def _sizes(column: pa.Array) -> np.ndarray:
    """Lengths of a list column; null lists are empty."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of a list column; null lists are empty."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), _sizes(column))


#: Words worked on at once; a single longer document or sentence is one piece.
WORDS = 60_000


def _cuts(sizes: np.ndarray, most: int = WORDS) -> list[tuple[int, int]]:
    """Ranges of consecutive entries with about `most` in sum, at least one entry each."""
    if not len(sizes):
        return []
    group = (np.cumsum(sizes) - sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    return list(zip(starts, starts[1:]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a bounded number of words in column 1."""
    for b in batches:
        for lo, hi in _cuts(_sizes(b.column(1))):
            yield b.slice(lo, hi - lo)


def infer(word: np.ndarray, group: np.ndarray, count: np.ndarray, n_groups: int, beta: np.ndarray, prior: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each entry by topic, words of each group by topic), with rows of prior for the groups.

    Entries must be sorted by group. A round needs the likelihood of each entry under its group's proportions only, and
    sums over the entries of a group, which lie together.
    """
    has, starts = np.unique(group, return_index=True)
    like, theta, total = beta[word], prior.astype(beta.dtype), np.zeros(prior.shape, beta.dtype)
    at, count = np.searchsorted(has, group), count.astype(beta.dtype)
    t = theta[has]
    for _ in range(inner):
        share = count / (np.einsum("ij,ij->i", like, t[at]) + beta.dtype.type(1e-30))
        inside = t * np.add.reduceat(like * share[:, None], starts, axis=0)
        t = inside + theta[has]
    share = count / (np.einsum("ij,ij->i", like, t[at]) + beta.dtype.type(1e-30))
    r = like * t[at] * share[:, None]
    total[has] = np.add.reduceat(r, starts, axis=0)
    return r, total


def _tongues(beta: np.ndarray, spoken: np.ndarray, n_subjects: int, background: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words x languages, [(topics, words x topics) of each language, then of all]), in single precision."""
    n_l, parts = spoken.shape[1], []
    for l in range(n_l):
        at = n_l * n_subjects + l * background
        topics = np.r_[l * n_subjects : (l + 1) * n_subjects, at : at + background]
        parts.append((topics, np.ascontiguousarray(beta[:, topics], np.float32)))
    return spoken.astype(np.float32), [*parts, (np.arange(beta.shape[1]), beta.astype(np.float32))]


def infer_by_language(word: np.ndarray, group: np.ndarray, count: np.ndarray, n_groups: int, tongues: tuple, prior: np.ndarray, inner: int, pure: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, topics, words of each entry by topic, words of each group by topic) of the groups of each language.

    A group of whose words `pure` or more are of one language is explained by the topics of that language, a mixed group by all. Prior
    has a column for every topic.
    """
    spoken, parts = tongues
    has, starts = np.unique(group, return_index=True)
    of = np.add.reduceat(spoken[word] * count[:, None], starts, axis=0)
    lang = np.full(n_groups, len(parts) - 1)
    lang[has] = np.where(of.max(1) >= pure * of.sum(1), of.argmax(1), len(parts) - 1)
    for l, (topics, beta) in enumerate(parts):
        at = np.flatnonzero(lang[group] == l)
        if len(at):
            yield at, topics, *infer(word[at], group[at], count[at], n_groups, beta, prior[:, topics], inner)


def _add_by(index: np.ndarray, rows: np.ndarray, total: np.ndarray, columns: np.ndarray | None = None) -> None:
    """total[index] += rows, with repeats, in some columns only if they are given."""
    order = np.argsort(index, kind="stable")
    has, starts = np.unique(index[order], return_index=True)
    sums = np.add.reduceat(rows[order], starts, axis=0)
    if columns is None:
        total[has] += sums
    else:
        total[has[:, None], columns] += sums


def _bag(word: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, count = np.unique(doc[word >= 0] * size + word[word >= 0], return_counts=True)
    return both % size, both // size, count.astype(np.float64)


def _label_prior(b: pa.RecordBatch, topics: int, n_subjects: int, n_languages: int, s: Settings) -> np.ndarray:
    """Prior of the topics; the labelled subjects' topics, which come first, by language, are raised."""
    prior = np.full((b.num_rows, topics), s.alpha)
    lab, doc = _flat(b.column(3))
    for l in range(n_languages):
        prior[doc, l * n_subjects + lab] += s.label_prior
    return prior


def _sum_by_word(df: DataFrame, fn, columns: int, size: int) -> np.ndarray:
    """Sum over all tasks of the (words x columns) matrices that fn makes of each piece."""
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        for b in _pieces(batches):
            fn(b, total)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(total[some, i]) for i in range(columns))], names=["w", *names])

    got = df.mapInArrow(run, "w bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("w").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((size, columns))
    out[got["w"].to_numpy(dtype=np.int64)] = got[names].to_numpy()
    return out


@dataclass
class Model:
    vocabulary: list[str]
    subjects: list[str]
    beta: np.ndarray  #: words, then buckets, x topics
    subject_of: list[int]  #: of each topic; -1 for background
    clear: np.ndarray  #: words x subjects, 0 to 1, how far the word may speak for the subject
    spoken: np.ndarray  #: words x languages, how much the word is of the language; rows sum to 1


def preferences(with_word: np.ndarray, labelled: np.ndarray, per_subject: np.ndarray, n: float) -> np.ndarray:
    """log of how much more often a subject's documents have a word than the others do; smoothed, never below 0."""
    inside = (with_word + 0.5) / (per_subject + 1.0)
    outside = (labelled[:, None] - with_word + 0.5) / (n - per_subject + 1.0)
    return np.maximum(0.0, np.log(inside / outside)) * (with_word >= 2)


def fit(docs: DataFrame, vocabulary: list[str], subjects: list[str], languages: int, s: Settings) -> Model:
    """The model of encoded docs (doc_id, ids, lens, labels, lang)."""
    size, n_s, n_l = len(vocabulary) + s.buckets, len(subjects), max(1, languages)
    topics = (n_s + s.background) * n_l
    spark = docs.sparkSession

    def start(b: pa.RecordBatch, total: np.ndarray) -> None:
        word, doc, _ = _bag(*_flat(b.column(1)), size)
        lab, of = _flat(b.column(3))
        lang = b.column(4).to_numpy(zero_copy_only=False)
        has = np.zeros((b.num_rows, n_s + 2 + n_l))
        has[of, lab] = 1
        has[:, n_s] = has[:, :n_s].any(1)
        has[:, n_s + 1] = 1
        has[np.flatnonzero(lang >= 0), n_s + 2 + lang[lang >= 0]] = 1
        if len(word):
            _add_by(word, has[doc], total)
        total[size] += has.sum(0)

    first = _sum_by_word(docs, start, n_s + 2 + n_l, size + 1)
    prefer = preferences(first[:size, :n_s], first[:size, n_s], first[size, :n_s], first[size, n_s])
    prefer[len(vocabulary) :] = 0  # a bucket holds words of all kinds
    rng = np.random.default_rng(s.seed)
    everywhere = first[:size, n_s + 1]
    # how much a word is of a language: its share of the language's documents against its share of all
    spoken = (first[:size, n_s + 2 :] + 0.1) / (first[size, n_s + 2 :] + 1.0)
    spoken = spoken / spoken.sum(1, keepdims=True)
    counts, tongue = np.zeros((size, topics)), np.zeros((size, topics))
    for l in range(n_l):
        mine = everywhere * spoken[:, l]
        counts[:, l * n_s : (l + 1) * n_s] = mine[:, None] * prefer**2 * 20
        at = n_l * n_s + l * s.background
        tongue[:, l * n_s : (l + 1) * n_s] = tongue[:, at : at + s.background] = spoken[:, [l]]
        counts[:, at : at + s.background] = mine[:, None] * rng.gamma(5.0, 0.2, (size, s.background)) * np.exp(-prefer.max(1, initial=0))[:, None]
    for _ in range(s.most_passes):
        tongues = spark.sparkContext.broadcast(_tongues((counts + s.beta) / (counts + s.beta).sum(0), spoken, n_s, s.background))

        def step(b: pa.RecordBatch, total: np.ndarray) -> None:
            word, doc, count = _bag(*_flat(b.column(1)), size)
            if len(word):
                for at, cols, r, _ in infer_by_language(word, doc, count, b.num_rows, tongues.value, _label_prior(b, topics, n_s, n_l, s), s.inner, s.pure):
                    _add_by(word[at], r, total, cols)

        # a topic keeps to its language: else one with few documents is taken over by passages in another
        before, counts = counts, _sum_by_word(docs, step, topics, size) * tongue
        tongues.unpersist()
        share = lambda c: c / max(c.sum(), 1e-9)
        if np.abs(share(counts) - share(before)).sum() < 2 * s.tolerance:
            break
    subject_of = map_topics(counts, prefer, s)
    return Model(vocabulary, subjects, (counts + s.beta) / (counts + s.beta).sum(0), subject_of, clearness(counts, subject_of, n_s, s), spoken)


def clearness(counts: np.ndarray, subject_of: list[int], n_subjects: int, s: Settings) -> np.ndarray:
    """words x subjects, 0 to 1: how far a word may speak for a subject, by how much more frequent it is in the topics of that subject than in all others."""
    own = np.zeros((counts.shape[1], n_subjects))
    for k, i in enumerate(subject_of):
        if i >= 0:
            own[k, i] = 1
    inside, everywhere = counts @ own, counts.sum(1, keepdims=True)
    lift = np.log((inside + 0.5) / (inside.sum(0) + 1.0)) - np.log((everywhere - inside + 0.5) / (everywhere.sum() - inside.sum(0) + 1.0))
    return np.clip(lift / s.preference, 0, 1)


def map_topics(counts: np.ndarray, prefer: np.ndarray, s: Settings) -> list[int]:
    """The subject that the top terms of each topic, by their weight in it, prefer; -1 where they prefer none clearly."""
    out = []
    lift = counts / (counts.sum(0) + 1e-9) / (counts.sum(1, keepdims=True) / max(counts.sum(), 1e-9) + 1e-9)
    for k in range(counts.shape[1]):
        top = np.argsort(-counts[:, k] * np.log1p(lift[:, k]), kind="stable")[: s.top_terms]
        weight = counts[top, k] / max(counts[top, k].sum(), 1e-9)
        score = weight @ prefer[top] if len(top) else np.zeros(prefer.shape[1])
        best = int(np.argmax(score)) if len(score) else -1
        rest = np.delete(score, best).max() if len(score) > 1 else 0.0
        out.append(best if best >= 0 and score[best] > 0.5 and score[best] > 1.5 * rest else -1)
    return out


def prepare(documents: DataFrame, subjects: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, list[str], list[str], int]:
    """(encoded docs, vocabulary, subjects, number of languages) of documents (doc_id, text, lang), subjects (subject), labels (doc_id, subject)."""
    spark = documents.sparkSession
    names = [r.subject for r in subjects.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    numbered = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "subject string, i int")
    given = labels.join(F.broadcast(numbered), "subject").groupBy("doc_id").agg(F.collect_set("i").alias("labels"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", language_key("lang").alias("lang")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    cut = store(_sentences(texts), "sentences").filter(F.size("hs") > 0)
    n = cut.count()
    # at most 1 / language_share languages are frequent enough
    tongues = cut.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= s.language_share * n).orderBy("lang").select("lang").collect()
    spoken = spark.createDataFrame([(r.lang, i) for i, r in enumerate(tongues)], "lang string, l int")
    kept = small(_frequencies(cut).filter(F.col("n") >= max(3, s.rarest * n)).select("h"), "vocabulary")
    named = cut.filter(F.size("new_h") > 0).select(F.explode(F.arrays_zip("new_h", "new_w")).alias("x")).select(F.col("x.new_h").alias("h"), F.col("x.new_w").alias("w"))
    rows = named.join(kept, "h", "left_semi").groupBy("h").agg(F.min("w").alias("w")).orderBy("w").collect()
    full = cut.join(F.broadcast(spoken), "lang", "left").join(given, "doc_id", "left").select("doc_id", "hs", "lens", "labels", F.coalesce("l", F.lit(-1)).alias("lang"))
    return store(_encode(full, np.array([r.h for r in rows], np.int64), s.buckets), "encoded"), [r.w for r in rows], names, len(tongues)


def assign(docs: DataFrame, model: Model, s: Settings, least: int = 2) -> DataFrame:
    """doc_id, subject, n_sentences, share: the subjects of the encoded docs; share is that of the document's words that fall to it."""
    size, topics, n_s = *model.beta.shape, len(model.subjects)
    own = np.zeros((topics, n_s))
    for k, i in enumerate(model.subject_of):
        if i >= 0:
            own[k, i] = 1
    known = docs.sparkSession.sparkContext.broadcast((_tongues(model.beta, model.spoken, n_s, s.background), own, model.subjects, model.clear))
    schema = "doc_id bigint, subject string, n_sentences bigint, share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongues, own, names, clear = known.value
        for b in _pieces(batches):
            word, doc = _flat(b.column(1))
            lens, of = _flat(b.column(2))
            sent = np.repeat(np.arange(len(lens)), lens)
            w, d, c = _bag(word, doc, size)
            if not len(w):
                continue
            total = np.zeros((b.num_rows, topics), np.float32)
            for _, cols, _, part in infer_by_language(w, d, c, b.num_rows, tongues, np.full((b.num_rows, topics), s.alpha), s.inner, s.pure):
                total[:, cols] += part
            prior = (total + s.alpha) / (total + s.alpha).sum(1, keepdims=True)
            about = np.zeros((len(lens), len(names)), bool)
            for lo, hi in _cuts(lens):
                at, to = np.searchsorted(sent, [lo, hi])
                w, e, c = _bag(word[at:to], sent[at:to] - lo, size)
                if len(w):
                    words = np.zeros((hi - lo, len(names)))
                    for x, cols, r, _ in infer_by_language(w, e, c, hi - lo, tongues, prior[of[lo:hi]] + np.float32(0.05), s.inner, s.pure):
                        _add_by(e[x], (r @ own[cols]) * clear[w[x]], words)
                    about[lo:hi] = words >= s.mass
            n = np.zeros((b.num_rows, len(names)), np.int64)
            np.add.at(n, of, about)
            share = (total @ own) / np.maximum(total.sum(1, keepdims=True), 1e-9)
            # a subject must have as many of the document's words as so many sentences need
            r, i = np.nonzero((n >= least) & (total @ own >= least * s.mass))
            ids = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array([names[x] for x in i], pa.string()), pa.array(n[r, i]), pa.array(share[r, i])], names=["doc_id", "subject", "n_sentences", "share"])

    return docs.mapInArrow(run, schema)


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, settings: Settings = Settings(), least: int = 2) -> tuple[DataFrame, Model]:
    """(doc_id, subject, n_sentences, share; model) for documents (doc_id, text, lang).

    Null and empty texts have no subject; null doc_ids are left aside. Labels of unknown subjects or documents have no
    effect. Without labels no topic can be mapped, and the result is empty. doc_id must be unique.
    """
    docs, vocabulary, names, languages = prepare(documents, subjects, labels, settings)
    model = fit(docs, vocabulary, names, languages, settings)
    return assign(docs, model, settings, least), model


def topic_terms(model: Model, spark: SparkSession, n: int = 15) -> DataFrame:
    """topic, subject (null for background), rank, term, weight: the top terms by which topics are mapped and can be inspected."""
    rows = []
    for k, i in enumerate(model.subject_of):
        for r, w in enumerate(np.argsort(-model.beta[: len(model.vocabulary), k], kind="stable")[:n]):
            rows.append((k, model.subjects[i] if i >= 0 else None, r + 1, model.vocabulary[w], float(model.beta[w, k])))
    return spark.createDataFrame(rows, "topic int, subject string, rank int, term string, weight double")
