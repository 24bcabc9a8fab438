"""Language identification by multilingual mixture inference.

A smoothed character-trigram model per language gives every word of a document
a likelihood under each language. Expectation-maximisation estimates the
document's language proportions from these likelihoods; the language set is the
one with the best penalised likelihood among the nested sets of the most likely
languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.llm.common import written

UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdParams:
    train_rows: int = 20_000    # labelled rows per language the model is fitted on, by hash order of the text
    dense_languages: int = 64   # up to so many languages the model is one table; beyond it only trigrams seen are held (same values)
    alphabet: int = 62          # most frequent letters with their own code; all others share one
    smoothing: float = 2.0      # weight of the letter distribution in a trigram's context
    floor: float = 0.02         # share of a flat letter distribution, so no language rules a letter out
    penalty: float = 6.0        # nats times log(words + 1) that each further language has to gain
    rounds: int = 30            # at most so many EM steps
    piece: int = 1_000_000      # characters handled at once


def _letter_bits() -> bytes:
    return np.packbits([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)]).tobytes()


def _pieces(text: str, size: int):
    """Cut a text into pieces of about ``size`` characters at white space (inside a longer word if there is none)."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b, at, at + size) for b in " \n")
        cut = at + size if cut <= at else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def _codes(text: str, table: np.ndarray) -> np.ndarray:
    """Letter codes of a text (0: no letter), with a boundary on both sides."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(2, np.int32), table[points], np.zeros(1, np.int32)])


def _trigrams(codes: np.ndarray, size: int):
    """Trigram ids of all letters and word ends, and the positions in them where words begin."""
    last, here = codes[1:-1], codes[2:]
    before = np.where(last > 0, codes[:-2], 0)
    used = (last > 0) | (here > 0)
    begins = np.flatnonzero(((last == 0) & (here > 0))[used])
    return ((before * size + last) * size + here)[used], begins


def _alphabet_rows(batches, bits: bytes):
    letter = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            found, n = np.unique(points, return_counts=True)
            total[found] += n
    found = np.flatnonzero((total > 0) & letter)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["point", "n"])


def _trigram_rows(batches, table: np.ndarray, place: dict[str, int], size: int, piece: int, held: int):
    """Counts of trigrams by label; counts of at most ``held`` labels are kept at once."""
    found: dict[int, np.ndarray] = {}

    def rows():
        for lang, total in found.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), lang, np.int32)), pa.array(seen), pa.array(total[seen])],
                                             names=["lang", "gram", "n"])
        found.clear()

    for batch in batches:
        for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lang = place[name]
            if lang not in found and len(found) >= held:
                yield from rows()
            for part in _pieces(text or "", piece):
                ids, _ = _trigrams(_codes(part, table), size)
                seen, n = np.unique(ids, return_counts=True)
                found.setdefault(lang, np.zeros(size ** 3, np.int64))[seen] += n
    yield from rows()


@dataclass(frozen=True)
class SparseTrigrams:
    """log p(here | before, last) = ``here``[last, here] - ``context``[before, last] + ``value`` of the trigram, if it was seen.

    The first two are tables (pairs of letters by languages); the values of a
    trigram lie between its ``start`` and the next one's, with their languages.
    """

    here: np.ndarray
    context: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    """Letter codes and the log-probability of every trigram's last letter, by language.

    ``log_p`` is a table of trigrams by languages, or, of many languages, holds
    the trigrams seen: about 32 KB and the distinct trigrams of each language.
    """

    languages: list[str]
    letters: dict[int, int]
    log_p: np.ndarray | SparseTrigrams
    letter_bits: bytes
    size: int

    def table(self) -> np.ndarray:
        return _code_table(self.letter_bits, self.letters)

    def word_scores(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-likelihood of every word (trigrams from ``begins`` on) under each language."""
        if isinstance(self.log_p, np.ndarray):
            return np.add.reduceat(self.log_p[ids], begins)
        p, n_langs = self.log_p, len(self.languages)
        word = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(ids))))
        out = np.zeros((len(begins), n_langs), np.float32)
        step = max(1024, 4_000_000 // n_langs)  # trigrams by languages held at once
        for at in range(0, len(ids), step):
            g, w = ids[at:at + step], word[at:at + step]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[first]] += np.add.reduceat(p.here[g % self.size ** 2] - p.context[g // self.size], first)
            n = p.start[g + 1] - p.start[g]
            at_value = np.repeat(p.start[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(w - w[0], n) * n_langs + p.lang[at_value]
            seen = np.bincount(cell, p.value[at_value], (w[-1] - w[0] + 1) * n_langs)
            out[w[0]:w[-1] + 1] += seen.reshape(-1, n_langs).astype(np.float32)
        return out


def _code_table(bits: bytes, letters: dict[int, int]) -> np.ndarray:
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int32)
    table[np.fromiter(letters, np.int64, len(letters))] = np.fromiter(letters.values(), np.int32, len(letters))
    return table


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
        params: LangIdParams = LangIdParams()) -> LanguageModel:
    """Fit the models on rows where ``train`` holds and the label is given.

    At most about ``train_rows`` distinct texts of a language take part, and every
    label gets a model. Labels of equally many texts are alike; texts that are
    equally likely in two languages get the first by name. What the driver
    gathers is bounded by the alphabet and the number of labels; an empty table
    gives a model without languages.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # copies of a text count once here too, so a label of few texts and many copies is learned from all its texts
    sizes = rows.select(F.col(lang).alias("_l"), F.xxhash64(text).alias("_h")).distinct().groupBy("_l").count().orderBy("_l").collect()
    bits = _letter_bits()
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), bits, params.alphabet + 2)
    share = F.element_at(F.map_from_arrays(F.lit([r["_l"] for r in sizes]),
                                           F.lit([min(1.0, params.train_rows / r["count"]) for r in sizes])), F.col(lang))
    draw = F.pmod(F.xxhash64(text), F.lit(1_000_000)) / F.lit(1e6)
    # copies of a text are drawn together and count once, so a very common text does not break the bound
    drawn = rows.where(draw < share).select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropDuplicates()
    sample = written(drawn, "langid")

    counted = sample.select("text").mapInArrow(lambda it: _alphabet_rows(it, bits), "point long, n long")
    top = counted.groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(params.alphabet)
    letters = {r["point"]: i + 2 for i, r in enumerate(top.collect())}
    size, piece, table = params.alphabet + 2, params.piece, _code_table(bits, letters)
    languages = sorted(r["_l"] for r in sizes)
    place, held = {name: k for k, name in enumerate(languages)}, max(1, params.dense_languages)
    grams = sample.mapInArrow(lambda it: _trigram_rows(it, table, place, size, piece, held), "lang int, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "gram"])
    log_p = _dense(grams, len(languages), size, params) if len(languages) <= params.dense_languages else \
        _sparse(grams, len(languages), size, params)
    return LanguageModel(languages, letters, log_p, bits, size)


def _smoothed(grams, lang: int, size: int, params: LangIdParams):
    """One language's trigrams and counts, p(here | last) and the counts of contexts (before, last)."""
    lo, hi = np.searchsorted(grams.lang.to_numpy(), [lang, lang + 1])
    gram, n = grams.gram.to_numpy()[lo:hi], grams.n.to_numpy()[lo:hi]
    n2 = np.bincount(gram % size ** 2, n, size ** 2).reshape(size, size)
    p1 = (1 - params.floor) * n2.sum(0) / max(n2.sum(), 1) + params.floor * np.full(size, 1 / size)
    p2 = (n2 + params.smoothing * p1) / (n2.sum(1, keepdims=True) + params.smoothing)
    return gram, n, p2, np.bincount(gram // size, n, size ** 2).reshape(size, size)


def _dense(grams, n_langs: int, size: int, params: LangIdParams) -> np.ndarray:
    log_p = np.zeros((size, size, size, n_langs), np.float32)
    for k in range(n_langs):
        gram, n, p2, context = _smoothed(grams, k, size, params)
        n3 = np.bincount(gram, n, size ** 3).reshape(size, size, size)
        log_p[..., k] = np.log((n3 + params.smoothing * p2) / (context[..., None] + params.smoothing))
    return log_p.reshape(-1, n_langs)


def _sparse(grams, n_langs: int, size: int, params: LangIdParams) -> SparseTrigrams:
    here, context = np.zeros((size ** 2, n_langs), np.float32), np.zeros((size ** 2, n_langs), np.float32)
    value = np.zeros(len(grams), np.float32)
    at = 0
    for k in range(n_langs):
        gram, n, p2, counts = _smoothed(grams, k, size, params)
        here[:, k], context[:, k] = np.log(params.smoothing * p2).ravel(), np.log(counts + params.smoothing).ravel()
        value[at:at + len(gram)] = np.log1p(n / (params.smoothing * p2.ravel()[gram % size ** 2]))
        at += len(gram)
    gram = grams.gram.to_numpy()
    order = np.argsort(gram, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=size ** 3))])
    return SparseTrigrams(here, context, start, grams.lang.to_numpy()[order], value[order])


def mixture(log_w: np.ndarray, begins: np.ndarray, allowed: np.ndarray, rounds: int):
    """EM for each document's language proportions.

    ``log_w``: words by languages; ``begins``: each document's first word (all
    documents have words); ``allowed``: documents by languages that may have a
    share. Returns the proportions and the log-likelihoods.
    """
    n_docs = len(begins)
    sizes = np.diff(np.append(begins, len(log_w)))
    peak = log_w.max(1, keepdims=True)
    like = np.exp(np.maximum(log_w - peak, -60.0))
    share = allowed / allowed.sum(1, keepdims=True)
    best, ll = share.copy(), np.zeros(n_docs)
    live, own, first = np.arange(n_docs), like, begins
    for step in range(rounds):
        n = sizes[live]
        joint = own * np.repeat(share, n, axis=0)
        total = joint.sum(1)
        ll[live] = np.add.reduceat(np.log(np.maximum(total, 1e-300)), first)
        joint /= np.maximum(total, 1e-300)[:, None]
        new = np.add.reduceat(joint, first) / n[:, None]
        moved = np.abs(new - share).max(1) > 1e-4
        best[live] = new
        if not moved.any():
            break
        share = new
        if moved.sum() < 0.7 * len(live):
            own = own[np.repeat(moved, n)]
            live, share = live[moved], share[moved]
            first = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
    return best, ll + np.add.reduceat(peak[:, 0].astype(float), begins)


def select_languages(log_w: np.ndarray, begins: np.ndarray, penalty: float, rounds: int):
    """Proportions in the language set of the best penalised likelihood, and a confidence for each document's first language."""
    n_docs, n_langs = len(begins), log_w.shape[1]
    sizes = np.diff(np.append(begins, len(log_w)))
    single = np.add.reduceat(log_w.astype(float), begins)
    first = single.argmax(1)
    cost = penalty * np.log(sizes + 1.0)
    share = np.eye(n_langs)[first]
    odds = single - single.max(1, keepdims=True)
    sure = 1.0 / np.exp(np.maximum(odds, -60.0)).sum(1)
    if n_langs > 1 and n_docs:
        free, ll = mixture(log_w, begins, np.ones((n_docs, n_langs)), rounds)
        value = single.max(1)
        # no larger set beats its own penalty unless all languages together do
        open_ = np.flatnonzero(ll - value > cost)
        if len(open_):
            part = log_w[np.repeat(np.isin(np.arange(n_docs), open_), sizes)]
            start = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
            rank = (-free[open_]).argsort(1).argsort(1)
            top, most, price = value[open_].copy(), ll[open_], cost[open_]
            for k in range(2, n_langs + 1):
                # a set of k languages is no likelier than all of them
                hope = most - (k - 1) * price > top
                if not hope.any():
                    break
                if hope.sum() < 0.7 * len(hope):
                    part = part[np.repeat(hope, sizes[open_])]
                    open_, rank, top, most, price = open_[hope], rank[hope], top[hope], most[hope], price[hope]
                    start = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
                got, ll = mixture(part, start, (rank < k).astype(float), rounds)
                gain = ll - (k - 1) * price
                better = gain > top
                top[better] = gain[better]
                share[open_[better]] = got[better]
                sure[open_[better]] = 1.0
    return share, share.max(1) * sure


def _predict_texts(texts: list, model: LanguageModel, table: np.ndarray, params: LangIdParams):
    """(language, score, proportions) of each text."""
    out = [(UNKNOWN, 0.0, {})] * len(texts)
    if not model.languages:
        return out
    size, n_langs = model.size, len(model.languages)
    at, todo = 0, []
    most = params.piece * min(1.0, params.dense_languages / n_langs)  # characters of several texts handled at once

    def flush():
        if not todo:
            return
        log_w = np.concatenate([w for _, w in todo])
        begins = np.concatenate([[0], np.cumsum([len(w) for _, w in todo])[:-1]])
        share, score = select_languages(log_w, begins, params.penalty, params.rounds)
        for (i, _), p, s in zip(todo, share, score):
            out[i] = (model.languages[int(p.argmax())], float(min(1.0, s)),
                      {model.languages[k]: float(p[k]) for k in range(n_langs) if p[k] > 0})
        todo.clear()

    for i, text in enumerate(texts):
        found = []
        for part in _pieces(text or "", params.piece):
            ids, begins = _trigrams(_codes(part, table), size)
            if len(ids):
                found.append(model.word_scores(ids, begins))
        if found:
            todo.append((i, np.concatenate(found)))
            at += len(text)
        if at > most:
            flush()
            at = 0
    flush()
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text",
            params: LangIdParams = LangIdParams()) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``languages`` (language to share) to every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learned. Texts of any length are read whole, in
    pieces. Other columns pass through untouched, whatever their names, except
    that columns named like the three results are replaced.
    """
    results = ["lang_pred", "score", "languages"]
    docs = docs.drop(*results)
    names, own = docs.columns, docs.schema

    def run(batches):
        table = model.table()
        for batch in batches:
            at = names.index(text)
            got = _predict_texts(batch.column(at).to_pylist(), model, table, params)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([list(g[2].items()) for g in got], pa.map_(pa.string(), pa.float64()))],
                names=[*names, *results])

    full = T.StructType([*own.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])
    return docs.mapInArrow(run, full)
