"""Evaluation texts leaking into training text.

Latent semantic retrieval. Texts are reduced to words; passages are windows of words with at least ``run`` words that
some item uses (less can't hold a leaked run). TF-IDF weights come from all passages, a randomised SVD of the
passage-term matrix is summed up over the partitions, and passages and item windows are compared as vectors in the
latent space. Each vector also carries the length of its part outside that space, so the product of two vectors is an
upper bound of the exact one and a search by it loses no pair. An index from the rarest word of each item window to the
window says which pairs are compared. Candidates are then checked word by word: a run of consecutive words for copies,
the longest common subsequence for paraphrases. Answers are looked up in the whole text of the documents found.

Items are searched for in blocks whose windows are broadcast, each of a bounded size; the corpus is never gathered.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise

# Names of the tags taken for markup; of these, the ones that stand inside a line and join what they part.
TAGS = (
    "a abbr article aside b big blockquote body br caption center cite code dd del details div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html "
    "i img input ins kbd label li main mark nav ol option p pre q s samp section select small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var wbr"
)
INLINE = "a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr"

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtfvb\"'/])")
_TEX = re.compile(r"\\(?:textbf|textit|texttt|textsc|text|emph|underline|mathbf|mathrm)\s*\{")
_INLINE = re.compile(rf"</?(?:{'|'.join(INLINE.split())})(?:\s[^<>]*)?/?>", re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(TAGS.split())})(?:\s[^<>]*)?/?>", re.I)
#: What may stand inside a word; underscores and backquotes stand around words and part them like punctuation.
_EMPHASIS = re.compile(r"\*+|~~")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " "


def words(text: str | None) -> list[str]:
    """The words of ``text``: lower case, without punctuation, markup, emphasis and invisible characters, escape
    sequences read."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, _TEX.sub(" ", text))
        if any("\ud800" <= c <= "\udfff" for c in text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _BLOCK.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(_EMPHASIS.sub("", text).casefold())


#: Most columns of the passages' matrix. Where there are more words, some share a column, which only makes products
#: greater: the search still
#: loses nothing, and what is summed up and broadcast keeps its bound whatever the number of items.
COLUMNS = 1 << 14


class Items:
    """A block of evaluation items as word ids, with their windows of ``run`` words."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], run: int):
        self.run, self.vocab = run, {}
        self.words, self.answers, self.ids = [], [], []
        for item, prompt, answer in rows:
            p, a = words(prompt), words(answer)
            if item is not None:
                at = [self.vocab.setdefault(w, len(self.vocab)) for w in p + a]
                self.ids.append(int(item))
                self.words.append(np.array(at, np.int32))
                self.answers.append(np.array(at[len(p):], np.int32))
        wins = [(i, k) for i, w in enumerate(self.words) for k in range(len(w) - run + 1)]
        self.owner = np.array([i for i, _ in wins], np.int32)
        self.windows = np.array([self.words[i][k : k + run] for i, k in wins], np.int32).reshape(len(wins), run)
        self.columns = max(1, min(len(self.vocab), COLUMNS))

    def blocks(self, most: int) -> Iterator[list[int]]:
        """The items' numbers in blocks of at most ``most`` windows, or of one item."""
        block: list[int] = []
        size = 0
        for i, w in enumerate(self.words):
            n = max(0, len(w) - self.run + 1)
            if n and size + n > most and block:
                yield block
                block, size = [], 0
            if n:
                block.append(i)
                size += n
        if block:
            yield block


_PAIRS = "doc_id bigint, item_id bigint, copied boolean, common int, answered boolean"
#: Bytes of item windows that one search broadcasts.
BLOCK_BYTES = 64 << 20


def column_sets(ids: np.ndarray, columns: int) -> np.ndarray:
    """The distinct columns of the words in each row of ``ids``, -1 elsewhere: a sparse row of the matrix (an id of -1
    stands for a word no item uses)."""
    s = np.sort(np.where(ids >= 0, ids % columns, -1), axis=1)
    again = s[:, 1:] == s[:, :-1]
    s[:, 1:][again] = -1
    return s


def projected(sets: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sums of the rows of ``m`` that each row of ``sets`` names. The last row of ``m``, of zeros, is that of column
    -1."""
    out = np.zeros((len(sets), m.shape[1]), np.float32)
    for k in range(sets.shape[1]):
        own = sets[:, k]
        if (own >= 0).any():
            out += m[own]
    return out


def weighted(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """``m`` with its rows weighted by ``idf``, and the row of zeros for column -1."""
    return np.vstack([m * idf[:, None], np.zeros((1, m.shape[1]))]).astype(np.float32)


def latent(sets: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF rows in the space of ``basis`` (already ``weighted``) with the length of what lies outside as one more
    coordinate: products are upper bounds of exact ones."""
    inside = projected(sets, basis)
    squares = np.append(idf * idf, 0).astype(np.float32)[sets].sum(1)
    rest = np.maximum(squares - (inside * inside).sum(1), 0.0)
    return np.hstack([inside, np.sqrt(rest)[:, None]]).astype(np.float32)


def shares(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each word's share of its column's square, least first; words no item uses have infinite ones. The least n add up
    to no more than the product with any row that n of the words, repeated ones counted, are in."""
    at = np.where(ids >= 0, ids % len(idf), -1)
    times = (at[:, :, None] == at[:, None, :]).sum(2)
    return np.sort(np.where(at >= 0, np.append(idf, 0)[at] ** 2 / times, np.inf), axis=1)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, ids below 0 never match; bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x >= 0:
            masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _rows_to_array(d: pd.DataFrame, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(d["ids"]), np.int32).reshape(len(d), width)


def passages(
    docs: DataFrame, items: Items, text: str = "text", key: str = "doc_id", steps: int = 2, least: int | None = None
) -> DataFrame:
    """(doc_id, pos, ids): every window of steps * run words, one each run words, with at least run words known to the
    items. Whole texts are read.

    Any (steps - 1) * run consecutive words lie in one window. The last windows are filled up with unknown words. With
    ``least`` only windows are given that hold what a pair needs: run known words in a row, or ``least`` of them within
    (steps - 1) * run words.
    """
    run, vocab = items.run, items.vocab
    fewest = run if least is None else min(run, least)

    def kept(known: np.ndarray) -> np.ndarray:
        enough = np.flatnonzero(known.sum(1) >= fewest)
        if least is None or not len(enough):
            return enough
        upto = np.zeros((len(enough), steps * run + 1), np.int32)
        np.cumsum(known[enough], axis=1, out=upto[:, 1:])
        row, near = ((upto[:, n:] - upto[:, :-n]).max(1) for n in (run, (steps - 1) * run))
        return enough[(row >= run) | (near >= least)]

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            out: list[tuple] = []
            for k, t in zip(d["k"].tolist(), d["t"].tolist(), strict=True):
                w = words(t)
                if len(w) < fewest:
                    continue
                ids = np.fromiter((vocab.get(x, -1) for x in w), np.int32, len(w))
                n = -(-len(w) // run)
                grid = np.full((n + steps - 1) * run, -1, np.int32)
                grid[: len(w)] = ids
                wins = np.lib.stride_tricks.sliding_window_view(grid, steps * run)[::run]
                for i in kept(wins >= 0):
                    out.append((k, int(i), wins[i].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "ids"]).astype({"doc_id": "int64", "pos": "int32"})

    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")
    ).mapInPandas(cut, "doc_id bigint, pos int, ids binary")


def _summed(df: DataFrame, part_sum, shape: tuple[int, ...], width: int, groups: int = 8) -> np.ndarray:
    """The sum over all passages of ``part_sum(ids)``: one array per task, added up in ``groups`` tasks, then in one,
    which sends the driver one array.

    Its size is bounded by COLUMNS, whatever the numbers of tasks, passages and items.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(shape, np.float64)
        for d in parts:
            for k in range(0, len(d), 1024):
                total += part_sum(_rows_to_array(d.iloc[k : k + 1024], width))
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % groups], "v": [total.tobytes()]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, np.float64)
        for d in parts:
            for v in d["v"]:
                total += np.frombuffer(v, np.float64).reshape(shape)
        yield pd.DataFrame({"g": [0], "v": [total.tobytes()]})

    sums = df.mapInPandas(each, "g int, v binary")
    for tasks in (groups, 1):
        sums = sums.repartition(tasks, "g").mapInPandas(add, "g int, v binary")
    total = sums.first()
    return np.zeros(shape) if total is None else np.frombuffer(total.v, np.float64).reshape(shape)


def basis_of(found: DataFrame, idf: np.ndarray, width: int, rank: int, rounds: int, seed: int) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix by randomised SVD: sparse rows times a thin
    matrix, summed over partitions."""
    columns = len(idf)
    thin = min(columns, rank + 8)

    def step(m: np.ndarray):
        def part(ids: np.ndarray) -> np.ndarray:
            sets = column_sets(ids, columns)
            z = projected(sets, m)
            flat = sets.ravel()
            at = np.flatnonzero(flat >= 0)
            at = at[np.argsort(flat[at], kind="stable")]
            out = np.zeros((columns, thin))
            if len(at):
                own, first = np.unique(flat[at], return_index=True)
                out[own] = np.add.reduceat(z[at // sets.shape[1]], first, axis=0) * idf[own][:, None]
            return out

        return part

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, thin)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_summed(found, step(weighted(q, idf)), (columns, thin), width) + 1e-12 * q)[0]
    m = weighted(q, idf)
    gram = _summed(found, lambda ids: (lambda z: z.T @ z)(projected(column_sets(ids, columns), m)), (thin, thin), width)
    _, vectors = np.linalg.eigh(gram)
    return (q @ vectors[:, ::-1][:, : min(rank, thin)]).astype(np.float32)


def leaks(
    docs: DataFrame, eval_rows: list[tuple[int, str | None, str | None]], run: int = 12, rank: int = 256,
    rounds: int = 2, paraphrase: float | None = None, seed: int = 7
) -> DataFrame:
    """(doc_id, item_id, copied, common, answered): the items found in each document, one row per pair.

    ``copied``: at least ``run`` consecutive words of the item (prompt, then answer) stand in the document in order.
    With ``paraphrase``: pairs are also given where 2 * run words of the document, wherever they begin, and the item
    have a common subsequence of at least that part of 2 * run words, or of the item's words if it has fewer
    (``common``: its greatest length, at least ``run`` for copies); ``answered``: the item has an answer and the
    document holds all of its words, in any place. Items with fewer than ``run`` words, null texts and ids match
    nothing. Empty inputs give no rows. ``eval_rows`` is one block of items, which each task holds; ``leaks_of`` makes
    blocks of any number of items.
    """
    items = Items(eval_rows, run)
    spark = docs.sparkSession
    if not len(items.windows):
        return spark.createDataFrame([], _PAIRS)
    columns = items.columns
    # Paraphrases stretch over 2 * run words, which only windows of one more step hold wherever they begin.
    steps = 3 if paraphrase else 2
    width = steps * run
    least = min(needed(min(len(w), 2 * run), paraphrase) for w in items.words if len(w) >= run) if paraphrase else None
    found = materialise(passages(docs, items, steps=steps, least=least), "passages")

    def df_part(ids: np.ndarray) -> np.ndarray:
        sets = column_sets(ids, columns)
        return np.append(np.bincount(sets[sets >= 0], minlength=columns), len(ids)).astype(np.float64)

    counts = _summed(found, df_part, (columns + 1,), width)
    idf = (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1).astype(np.float32)
    basis = basis_of(found, idf, width, rank, rounds, seed)
    per_block = max(1, BLOCK_BYTES // (4 * (rank + 1 + run)))
    pairs = None
    for block in items.blocks(per_block):
        part = found.mapInPandas(
            _searcher(spark, items, block, idf, basis, width, paraphrase),
            "doc_id bigint, item_id bigint, copied boolean, common int"
        )
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.max("copied").alias("copied"), F.max("common").alias("common"))
    if not paraphrase:
        return pairs.withColumn("answered", F.lit(False))
    pairs = materialise(pairs, "pairs")
    return pairs.join(
        _answers(docs, pairs, items), ["doc_id", "item_id"], "left"
    ).withColumn("answered", F.coalesce("answered", F.lit(False)))


def needed(n: int, part: float) -> int:
    """How many of ``n`` words are ``part`` of them."""
    return max(1, math.ceil(part * n - 1e-9))


def _answers(docs: DataFrame, pairs: DataFrame, items: Items, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, answered): the pairs whose document holds all words of the item's answer. Only texts of
    documents in ``pairs`` are read again."""
    vocab, run = items.vocab, items.run
    answers: dict[int, list[np.ndarray]] = {}
    for i, w, a in zip(items.ids, items.words, items.answers, strict=True):
        if len(a) and len(w) >= run:
            answers.setdefault(i, []).append(np.unique(a))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            out = []
            for k, t, ids in zip(d["k"].tolist(), d["t"].tolist(), d["ids"], strict=True):
                held = {vocab[w] for w in words(t) if w in vocab}
                out += [
                    (k, i, True) for i in map(int, ids) if any(held.issuperset(a.tolist()) for a in answers.get(i, []))
                ]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "answered"]).astype(
                {"doc_id": "int64", "item_id": "int64", "answered": bool}
            )

    here = docs.select(
        F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")
    ).where("k is not null and t is not null")
    wanted = pairs.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("item_id").alias("ids"))  # at most all items
    return here.join(wanted, "k").select("k", "t", "ids").mapInPandas(
        look, "doc_id bigint, item_id bigint, answered boolean"
    ).distinct()


def _searcher(
    spark: SparkSession, items: Items, block: list[int], idf: np.ndarray, basis: np.ndarray, width: int,
    paraphrase: float | None
):
    """The search for the items numbered ``block``, as a function over passages of ``width`` words. What it broadcasts
    has a bound: the block's windows in the latent space.

    A window is looked at only in passages that hold its rarest word, by an index from word to windows, and there by the
    cosine search.
    """
    run, reach, columns = items.run, 2 * items.run, items.columns
    mine = np.isin(items.owner, block)
    windows, owner = items.windows[mine], items.owner[mine]
    rarest = windows[np.arange(len(windows)), idf[windows % columns].argmax(1)]
    order = np.argsort(rarest, kind="stable")
    windows, owner, rarest = windows[order], owner[order], rarest[order]
    first = np.searchsorted(rarest, np.arange(len(items.vocab) + 1)).astype(np.int64)  # where each word's windows begin
    space = weighted(basis, idf)
    sets = column_sets(windows, columns)
    query = latent(sets, idf, space)
    norm2 = np.append(idf * idf, 0).astype(np.float32)[sets].sum(1)
    # For paraphrases: which of the block's words each item has, and how many of them have to be found.
    short, has, col, need, whole = sorted(block), None, None, None, None
    if paraphrase:
        mine_words = np.unique(np.concatenate([items.words[i] for i in short]))
        col = np.zeros(len(items.vocab) + 1, np.int32)  # 0: no word of the block; also what id -1 gets
        col[mine_words] = np.arange(1, len(mine_words) + 1)
        has = np.zeros((len(short), len(mine_words) + 1), bool)
        for j, i in enumerate(short):
            has[j, col[items.words[i]]] = True
        need = np.array([needed(min(len(items.words[i]), reach), paraphrase) for i in short], np.int32)
        whole = np.vstack([latent(column_sets(items.words[i][None, :], columns), idf, space) for i in short]).T.copy()
    known = {i: items.ids[i] for i in block}
    texts = [items.words[i] for i in short]
    shared = spark.sparkContext.broadcast(
        (windows, owner, known, first, query, norm2, space, idf, short, texts, has, col, need, whole)
    )

    def common(ids: np.ndarray, text: np.ndarray, least: int) -> int:
        """The longest common subsequence of ``text`` and ``reach`` words of ``ids``; 0 if below ``least``."""
        if lcs(ids, text) < least:
            return 0
        best = max(lcs(ids[k : k + reach], text) for k in range(width - reach + 1))
        return best if best >= least else 0

    def indexed(ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, windows) by rarest words, some 16 thousand pairs at a time."""
        own = np.sort(ids, axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
        row, _ = at = np.nonzero(own >= 0)
        word = own[at]
        n = first[word + 1] - first[word]
        row, word, n = row[n > 0], word[n > 0], n[n > 0]
        upto = np.cumsum(n)
        start = 0
        while start < len(n):
            end = max(
                start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + (1 << 14), side="right"))
            )
            k = n[start:end]
            before = np.repeat(np.cumsum(k) - k, k)
            yield np.repeat(row[start:end], k), np.repeat(first[word[start:end]], k) + np.arange(k.sum()) - before
            start = end

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, owner, known, first, query, norm2, space, idf, short, texts, has, col, need, whole = shared.value
        factors = np.random.default_rng(1).integers(1, 1 << 62, run, np.int64)
        code = (windows * factors).sum(1)
        for d in parts:
            out: dict[tuple[int, int], list] = {}
            for k in range(0, len(d), 512):
                b = d.iloc[k : k + 512]
                ids, docs_ = _rows_to_array(b, width), b["doc_id"].to_numpy()
                x = latent(column_sets(ids, len(idf)), idf, space)
                runs = np.lib.stride_tricks.sliding_window_view(ids, run, axis=1)
                codes = (runs * factors).sum(2)
                for ps, ws in indexed(ids, first):
                    # A passage that holds all words of a window has a product of at least the window's own square.
                    near = np.einsum("ij,ij->i", x[ps], query[ws]) >= norm2[ws] * np.float32(0.999)
                    ps, ws = ps[near], ws[near]
                    equal = (codes[ps] == code[ws][:, None]).any(1)
                    for p, w in zip(ps[equal].tolist(), ws[equal].tolist(), strict=True):
                        key = (int(docs_[p]), known[owner[w]])
                        if (key not in out or not out[key][0]) and (runs[p] == windows[w]).all(1).any():
                            out[key] = [True, max(run, out.get(key, [False, 0])[1])]
                if whole is None:
                    continue
                # A passage that shares so many words with an item has a product with it of at least the least so many
                # shares.
                floor = shares(ids, idf)[:, : int(need.min())].sum(1, dtype=np.float32) * np.float32(0.999)
                near_p, near_i = np.nonzero(x @ whole >= floor[:, None])
                for c in range(0, len(near_p), 1 << 16):
                    ps, js = near_p[c : c + (1 << 16)], near_i[c : c + (1 << 16)]
                    upto = np.zeros((len(ps), width + 1), np.int32)
                    np.cumsum(has[js[:, None], col[ids[ps]]], axis=1, out=upto[:, 1:])
                    have = (upto[:, reach:] - upto[:, :-reach]).max(1)
                    at = np.flatnonzero(have >= need[js])
                    at = at[np.argsort(-have[at], kind="stable")]
                    for p, j, most in zip(ps[at].tolist(), js[at].tolist(), have[at].tolist(), strict=True):
                        key = (int(docs_[p]), known[short[j]])
                        old = out.get(key, [False, 0])
                        if most > old[1] and (n := common(ids[p], texts[j], max(int(need[j]), old[1] + 1))):
                            out[key] = [old[0], n]
            rows = [(*k, *v) for k, v in out.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "copied", "common"]).astype(
                {"doc_id": "int64", "item_id": "int64", "copied": bool, "common": "int32"}
            )

    return search


def leaks_of(docs: DataFrame, items: DataFrame, block: int = 20_000, **more) -> DataFrame:
    """``leaks`` for a table of items (item_id, prompt, answer) of any size, ``block`` of them at a time: the driver and
    the tasks hold one block.

    Each block reads the corpus once. An item_id that is there several times counts as all of its texts.
    """
    rows, parts = [], []
    for r in items.select("item_id", "prompt", "answer").toLocalIterator():
        rows.append((r[0], r[1], r[2]))
        if len(rows) == block:
            parts.append(leaks(docs, rows, **more))
            rows = []
    if rows or not parts:
        parts.append(leaks(docs, rows, **more))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id", "item_id").agg(
        F.max("copied").alias("copied"), F.max("common").alias("common"), F.max("answered").alias("answered")
    )
