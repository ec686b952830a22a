"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, settle, small, whole
from tidebar.session import owned, stage

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ADD = 0.1
GRAIN = 4096.0  # expected counts are summed in units of 1/4096: whole numbers add up alike in any order


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case; bytes.split cuts at exactly the separators of a word."""
    return text.translate(_UPPER).split()


def texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def pack(ids: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, lowest first: the upper planes, nearly all zero, take no room in a compressed file."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Model:
    """States with start, transition and emission probabilities over symbols.

    Symbol 0 is the end of a text; those after the lexicon's are a word that occurs once and one unseen in training.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (states), (states, states), (symbols, states)

    @classmethod
    def of(cls, counts: np.ndarray, prior: np.ndarray, states: int, strength: float = 200.0) -> Model:
        """From expected counts: rows 0 to S-1 the symbols, then the transitions, then the starts; ``prior`` smooths emissions."""
        n = len(prior)
        emit = counts[:n] + strength * prior[:, None]
        move = counts[n : n + states] + 1.0 + 10.0 * np.eye(states)
        start = counts[n + states] + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, docs: list[np.ndarray]):
        """Time-major layout of texts sorted by falling length: per step the first ones are still running."""
        lengths = np.array([len(d) for d in docs])
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than t
        begin = np.r_[0, np.cumsum(running)]
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        doc = np.repeat(np.arange(len(docs)), lengths)
        at = begin[place] + doc
        symbol = np.empty(len(at), np.int64)
        symbol[at] = np.concatenate(docs)
        step = np.empty(len(at), np.int64)
        step[at] = place
        alpha = self.emit.take(symbol, axis=0)
        scale, ones = np.empty(len(at)), np.ones(len(self.start))
        now = np.broadcast_to(self.start, (len(docs), len(self.start)))
        for t in range(lengths[0]):
            a, b = begin[t], begin[t + 1]
            here = alpha[a:b]
            here *= now[: b - a]
            scale[a:b] = here @ ones  # the product is faster than a sum of so short rows
            here *= 1 / scale[a:b, None]
            now = here @ self.move
        return alpha, scale, symbol, step, begin, doc, at

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of each text; docs sorted by falling length."""
        _, scale, _, _, _, doc, at = self.forward(docs)
        return np.bincount(doc, np.log10(scale[at]), minlength=len(docs))

    def expected(self, docs: list[np.ndarray], out: np.ndarray | None = None) -> np.ndarray:
        """Expected counts of emissions, transitions and starts, in the layout of :meth:`of`, added to ``out``.

        Posteriors take the place of the forward values, step by step from the
        end, so that one value per token and state is held at a time.
        """
        alpha, scale, symbol, _, begin, _, _ = self.forward(docs)
        n, k = self.emit.shape
        out = np.zeros((n + k + 1, k)) if out is None else out
        last, moves = np.ones((0, k)), np.zeros((k, k))
        for t in range(len(begin) - 2, -1, -1):
            a, b = begin[t], begin[t + 1]
            here = np.ones((b - a, k))
            here[: len(last)] = last @ self.move.T
            last = self.emit.take(symbol[a:b], axis=0)
            last *= 1 / scale[a:b, None]
            last *= here
            if t:  # the texts of this step are the first ones of the step before
                moves += alpha[begin[t - 1] : begin[t - 1] + b - a].T @ last
            alpha[a:b] *= here
        for s in range(k):
            out[:n, s] += np.bincount(symbol, alpha[:, s], minlength=n)
        out[n : n + k] += self.move * moves
        out[n + k] += alpha[: begin[1]].sum(0)
        return out


def bundles(docs: list[np.ndarray], size: int = 400_000):
    """Places of texts in order of falling length, in groups of about ``size`` tokens; a longer text is its own group."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    group, n = [], 0
    for i in order:
        if group and n + len(docs[i]) > size:
            yield group
            group, n = [], 0
        group.append(i)
        n += len(docs[i])
    if group:
        yield group


def neighbours(coded: DataFrame, symbols: int) -> DataFrame:
    """(cell, n): how often the second symbol of a cell follows the first, over whole texts; numbers from ``symbols - 1`` on count as one symbol."""

    def count(batches):
        found = np.zeros(symbols * symbols, np.int64)
        for batch in small(batches):
            ids = np.concatenate([unpack(x) for x in batch.column("coded").to_pylist()])
            ids = np.minimum(ids, symbols - 1).astype(np.int64)
            found += np.bincount(ids[:-1] * symbols + ids[1:], minlength=len(found))
        found[:symbols] = 0  # nothing follows the end of a text
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(found[cells], pa.int64())], names=["cell", "n"])

    return coded.select("coded").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def first_model(pairs: np.ndarray, prior: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """Baum-Welch on counts of neighbouring symbols (symbol, next symbol), each pair a text of two, from random emissions."""
    n = len(prior)
    counts = np.zeros((n + states + 1, states))
    counts[:n] = pairs.sum() / states * prior[:, None] * np.random.default_rng(seed).gamma(1.0, size=(n, states))
    counts[n : n + states] = 20.0 * np.eye(states)
    model = Model.of(counts, prior, states)
    for _ in range(rounds if pairs.any() else 0):
        first = model.emit * model.start
        before = first @ model.move
        ratio = pairs / (before @ model.emit.T)
        first_counts = first * (ratio @ (model.emit @ model.move.T))
        counts[:n] = first_counts + model.emit * (ratio.T @ before)
        counts[0] *= 2  # a word is the first of one pair and the second of another, the end only the second
        counts[n : n + states] = model.move * (first.T @ ratio @ model.emit)
        counts[n + states] = first_counts.sum(0)
        model = Model.of(counts, prior, states)
    return model


def word_counts(train: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n) over whole texts (column ``text``), the end token left out; tasks count first, then words are shuffled."""

    def count(batches):
        seen: Counter = Counter()
        for batch in small(batches):
            for text in texts(batch):
                seen.update(tokens(text))
            if len(seen) >= flush:
                yield out(seen)
                seen.clear()
        yield out(seen)

    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return train.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """Up to ``most`` words of the highest counts, in falling order: all from the class of counts on above which no more than that lie."""
    classes = F.floor(F.log2("n") * 64).cast("int").alias("class")
    sizes = counts.groupBy(classes).agg(F.count("*").alias("words")).collect()  # 64 classes per doubling
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["class"]):
        total += row["words"]
        if total > most:
            break
        least = row["class"]
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(F.floor(F.log2("n") * 64).cast("int") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return top.column("word").to_pylist(), top.column("n").to_numpy()


def encode(docs: DataFrame, names: list[bytes], logs: np.ndarray, size: int) -> DataFrame:
    """Texts as packed numbers, in blocks of about ``size`` words, held-out ones apart from the others.

    0 is the end, 1 to ``len(names)`` the words of the lexicon; further numbers
    are the block's other words in order of appearance, which ``asked`` lists where
    they appear first, from number ``asked_from`` on.
    """
    table, symbols = docs.sparkSession.sparkContext.broadcast((names, logs)), len(names) + 1

    def run(batches):
        names, logs = table.value
        place = {w: i for i, w in enumerate(names, 1)}.get
        number = TaskContext.get().partitionId() << 33
        open_ = {flag: [number + flag, {}, 0] for flag in (False, True)}  # block, other words, words so far
        for batch in small(batches):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            found = [tokens(data) for data in texts(batch)]
            for flag in (False, True):
                for group in blocks(np.flatnonzero(held == flag), found, size):
                    block, others, n = open_[flag]
                    first, out = len(others), []
                    for r in group:
                        ids = np.fromiter(map(place, found[r], repeat(-1)), np.int64, len(found[r]))
                        known = ids[ids >= 0]
                        for i in np.flatnonzero(ids < 0).tolist():
                            ids[i] = symbols + others.setdefault(found[r][i], len(others))
                        out.append((len(ids) + 1, pack(np.r_[ids, 0]), float(logs[known].sum() + logs[0]), len(known)))
                        n += len(ids)
                    part = batch.take(pa.array(group))
                    kinds = (pa.int64(), pa.binary(), pa.float64(), pa.int64())
                    asked = [None] * len(group)
                    asked[0] = list(islice(others, first, None))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("key"), part.column("held_out"), pa.array([block] * len(group), pa.int64()),
                         *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), pa.array(asked, pa.list_(pa.binary())), pa.array([first] * len(group), pa.int64())],
                        names=["row", "key", "held_out", "block", "n_tokens", "coded", "base", "n_lexicon", "asked", "asked_from"],
                    )
                    open_[flag] = [block, others, n] if n < size else [block + 2, {}, 0]

    given = docs.select(F.monotonically_increasing_id().alias("row"), "key", "held_out", "text")
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(
        run, f"row long, key {kind}, held_out boolean, block long, n_tokens long, coded binary, base double, n_lexicon long, asked array<binary>, asked_from long"
    )


class Learned:
    """What :func:`learn` gives: texts as numbers, the model of the common symbols, and a table of the other words' emissions.

    ``coded``: key, held_out, block, n_tokens, coded, base_score, n_known. Numbers
    in ``coded`` are those of ``model``, then those of the block's other words,
    whose place in ``words`` the table ``pairs`` (block, at, i) has.
    """

    def __init__(self, coded: DataFrame, model: Model, names: list[bytes], words: DataFrame, emissions: DataFrame, pairs: DataFrame, train_tokens: int):
        self.coded, self.model, self.names, self.words, self.emissions, self.pairs = coded, model, names, words, emissions, pairs
        self.train_tokens, self.states = train_tokens, len(model.start)


def learn(
    df: DataFrame, key: str, text: str, held_out: Column, states: int = 8, lexicon: int = 262_144,
    rounds: int = 2, first_rounds: int = 100, sample_tokens: int | None = None, block_tokens: int = 4_000_000, calm: float = 2.0, seed: int = 42, pair_symbols: int = 512,
) -> Learned:
    """Train on the rows that are not held out, and encode all of them; see :func:`score`."""
    spark = df.sparkSession
    docs = df.select(col(key).alias("key"), F.coalesce(held_out, F.lit(True)).alias("held_out"), whole(text).alias("text"))
    mine: list[str] = []
    with owned(mine):
        counts = stage(word_counts(docs.where("NOT held_out").select("text")), "lm-counts")
    n_train = docs.where("NOT held_out").count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + n_train, kinds + (n_train > 0)
    below = total + ADD * (kinds + 1)
    unseen = ADD / below
    names, times = frequent(counts.where("n > 1"), lexicon)
    head = (np.r_[n_train, times] + ADD) / below  # place 0 is the end
    symbols = len(names) + 1
    with owned(mine):
        raw = stage(encode(docs, names, np.log10(head), block_tokens), "lm-raw")
        outside = counts.join(frequent_words(spark, names), F.col("word") == F.col("_name"), "left_anti")
        outside = stage(outside.select("word", "n", (-1 - F.monotonically_increasing_id()).alias("i")), "lm-outside")
    once = outside.where("n = 1").count()
    words = stage(outside.where("n > 1"), "lm-words")
    asked = raw.select("block", F.col("asked_from"), F.posexplode("asked").alias("place", "w"))
    asked = asked.join(outside, F.col("w") == F.col("word")).select("block", (F.col("asked_from") + F.col("place")).alias("at"), "n", "i")
    with owned(mine):
        asked = stage(asked, "lm-asked")  # a word that no training text has stays without a row
    logs = np.log10([unseen, (1 + ADD) / below])

    def resolve(rows: pa.Table, known: pa.Table) -> pa.Table:
        """Words outside the lexicon: seen once, never seen, or a number of their own."""
        docs = [unpack(x) for x in rows.column("coded").to_pylist()]
        size = max((int(d.max()) for d in docs), default=0) + 1
        symbol, logp, seen = np.arange(size), np.full(size, logs[0]), np.zeros(size, bool)
        symbol[symbols:], logp[:symbols] = symbols + 1, 0.0
        at, n = known.column("at").to_numpy() + symbols, known.column("n").to_numpy()
        symbol[at] = np.where(n > 1, at + 2, symbols)
        logp[at], seen[at] = np.log10((n + ADD) / below), True
        out = {c: rows.column(c) for c in ("row", "key", "held_out", "block", "n_tokens")}
        out["coded"] = pa.array([pack(symbol[d]) for d in docs], pa.binary())
        out["base_score"] = pa.array([b + float(logp[d].sum()) for b, d in zip(rows.column("base").to_pylist(), docs)], pa.float64())
        out["n_known"] = pa.array([k + int(seen[d].sum()) + (n_train > 0) for k, d in zip(rows.column("n_lexicon").to_pylist(), docs)], pa.int64())
        return pa.table(out)

    kind = docs.schema["key"].dataType.simpleString()
    narrow = raw.drop("asked", "asked_from")
    coded = narrow.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        resolve, f"row long, key {kind}, held_out boolean, block long, n_tokens long, coded binary, base_score double, n_known long"
    )
    coded = stage(coded, "lm-coded")
    pairs = stage(asked.where("n > 1").select("block", "at", "i"), "lm-pairs")
    del counts, raw, outside, asked, narrow
    settle(spark, mine)

    train = coded.where("NOT held_out").select("row", "key", "block", "coded")
    paired = train
    if sample_tokens is not None:
        share = min(1.0, sample_tokens / max(total, 1))
        paired = train.where(F.pmod(F.xxhash64(F.lit(seed), "key", "row"), F.lit(1 << 30)) < int(share * (1 << 30)))
    often = min(pair_symbols, symbols + 1)  # the end, the most frequent words and one symbol for all others
    found = neighbours(paired, often).toArrow()
    pairs_of = np.zeros(often * often)
    pairs_of[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    rest = max(1 - head[: often - 1].sum(), unseen)  # of all other words, seen and unseen
    model = first_model(pairs_of.reshape(often, often), np.r_[head[: often - 1], rest], states, first_rounds, seed)
    shared = model.emit[-1] / rest
    emit = np.r_[model.emit[:-1], head[often - 1 :, None] * shared]
    model = Model(model.start, model.move, np.r_[emit, [shared * (1 + ADD) / below], np.full((1, states), unseen)])
    prior = (F.col("n") + ADD) / below
    emissions = words.select("i", *((prior * float(x)).cast("float").alias(f"s{k}") for k, x in enumerate(shared)))
    used: list[str] = []
    for _ in range(rounds if n_train else 0):
        model, emissions, made = _round(train.select("block", "coded"), pairs, emissions, words, model, np.r_[head, once * (1 + ADD) / below], once, below, calm)
        settle(spark, used)
        used = made
    return Learned(coded, model, names, words, emissions, pairs, total)


def score(
    df: DataFrame, key: str, text: str, held_out: Column, states: int = 8, lexicon: int = 262_144,
    rounds: int = 2, first_rounds: int = 100, sample_tokens: int | None = None, block_tokens: int = 4_000_000, calm: float = 2.0, seed: int = 42, pair_symbols: int = 512,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, trained on rows that are not held out.

    Every word that occurs twice in the training texts has its own emissions,
    learned from all training texts, so the model grows with the corpus. Up to
    ``lexicon`` most frequent words and what is known of them are sent to the tasks
    (a bounded table). The others, each a small part of all tokens, are a stored
    table (word, states): a block of texts asks once for each of its words there,
    by a join on the word, and tasks return expected counts that Spark sums by
    word. Words outside the lexicon that occur once share one class, split evenly;
    words without any occurrence have exactly their base probability in every
    state, the others are scaled to what is left.

    The model starts from the counts of neighbouring tokens of all training texts,
    in which the end and the ``pair_symbols - 2`` most frequent words are symbols of
    their own and all other words share one, as the base model splits it (a table
    of at most ``pair_symbols`` squared numbers): ``first_rounds`` rounds of
    Baum-Welch on these counts. ``rounds`` rounds over all training texts and words
    follow. A caller who gives ``sample_tokens`` has the pairs counted in about so many
    tokens, taken by hash of key and row; by default all are.

    Null and empty texts have the end token only. Ties in frequency go by the
    word's bytes. A null ``held_out`` means held out. Without training texts all
    words are unknown and the model is the base model. Repeated rows are scored alike. A
    text of n words is one task's work, O(n) in time and memory; so is a block of
    about ``block_tokens`` words of one input partition.
    """
    known = learn(df, key, text, held_out, states, lexicon, rounds, first_rounds, sample_tokens, block_tokens, calm, seed, pair_symbols)
    final = df.sparkSession.sparkContext.broadcast(known.model)

    def likelihood(rows: pa.Table, found: pa.Table) -> pa.Table:
        docs = [unpack(x) for x in rows.column("coded").to_pylist()]
        own, hidden = with_others(final.value, docs, found), np.empty(len(docs))
        for group in bundles(docs):
            hidden[group] = own.log10([docs[i] for i in group])
        names = ["key", "held_out", "n_tokens", "n_known", "base_score"]
        return pa.table([*(rows.column(n) for n in names), pa.array(hidden)], names=[*names, "score"])

    coded = known.coded.select("key", "held_out", "block", "n_tokens", "n_known", "base_score", "coded")
    found = known.pairs.join(known.emissions, "i").select("block", "at", *(f"s{k}" for k in range(states)))
    kind = coded.schema["key"].dataType.simpleString()
    scored = coded.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        likelihood, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("key", "held_out", "n_tokens", "n_known", F.lit(known.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def blocks(rows: np.ndarray, found: list[list[bytes]], size: int):
    """``rows`` in groups of about ``size`` words; a longer text is its own group."""
    group, n = [], 0
    for r in rows.tolist():
        if group and n + len(found[r]) > size:
            yield group
            group, n = [], 0
        group.append(r)
        n += len(found[r])
    if group:
        yield group


def frequent_words(spark, names: list[bytes]) -> DataFrame:
    """The words of the lexicon as a table (a bounded one)."""
    return spark.createDataFrame(pa.table({"_name": pa.array(names, pa.binary())}))


def with_others(model: Model, docs: list[np.ndarray], found: pa.Table) -> Model:
    """The model with the emissions of a block's words that have a number of their own: ``found`` has them by their place ``at``."""
    common = len(model.emit)
    size = max((int(d.max()) for d in docs), default=0) + 1
    if size <= common:
        return model
    emit = np.ones((size, model.emit.shape[1]))
    emit[:common] = model.emit
    at = found.column("at").to_numpy() + common
    here = at < size  # the rest are the block's words in no text of these
    emit[at[here]] = np.column_stack([found.column(f"s{k}").to_numpy() for k in range(emit.shape[1])])[here]
    return Model(model.start, model.move, emit)


def _round(train: DataFrame, pairs: DataFrame, emissions: DataFrame, words: DataFrame, model: Model, prior: np.ndarray, once: int, below: float, calm: float):
    """One round of Baum-Welch: blocks of texts give expected counts, Spark sums them by symbol or word.

    The model, the emissions of ``words`` and the tables they rest on. ``prior`` is
    that of the lexicon and of the class of words that occur ``once``.
    """
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast(model)
    states, n, unseen = len(model.start), len(prior), ADD / below
    names = [f"s{k}" for k in range(states)]

    def expect(rows: pa.Table, found: pa.Table) -> pa.Table:
        docs = [unpack(x) for x in rows.column("coded").to_pylist()]
        own = with_others(sent.value, docs, found)
        size, total = len(own.emit), None
        for group in bundles(docs):
            total = own.expected([docs[i] for i in group], total)
        ids = np.r_[np.arange(size), n + np.arange(states + 1)]  # those of unseen words and of transitions never meet: no training word is unseen
        at = found.column("at").to_numpy() + n + 1
        here = at < size
        ids[at[here]] = found.column("i").to_numpy()[here]
        total *= GRAIN
        np.rint(total, out=total)
        any_ = np.flatnonzero(total.any(axis=1))
        return pa.table([pa.array(ids[any_]), *(pa.array(total[any_, k].astype(np.int64)) for k in range(states))], names=["i", *names])

    found = pairs.join(emissions, "i").select("block", "at", "i", *names)
    found = found.where(F.pmod("block", F.lit(2)) == 0)  # blocks of training texts
    parts = train.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(expect, "i long, " + ", ".join(f"{s} long" for s in names))
    made: list[str] = []
    with owned(made):
        sums = stage(parts.groupBy("i").agg(*(F.sum(s).alias(s) for s in names)), "lm-sums")
    # one row per symbol of the lexicon and state
    top = sums.where("i >= 0").toArrow()
    counts = np.zeros((n + states + 1, states))
    counts[top.column("i").to_numpy()] = np.column_stack([top.column(s).to_numpy() for s in names]) / GRAIN
    rare = sums.where("i < 0").agg(*(F.coalesce(F.sum(s), F.lit(0)) for s in names)).first()
    marginal = counts[:n].sum(0) + np.array(rare, float) / GRAIN + 1e-9
    marginal /= marginal.sum()

    # a word's base probability, times how much more or less often than all tokens it stands in a state
    drawn = np.r_[np.full(n - 1, calm), 0.0] if once else np.full(n, calm)  # the class is no rare word
    emit = prior[:, None] * (counts[:n] + drawn[:, None] * marginal) / ((counts[:n].sum(1) + drawn)[:, None] * marginal)
    times = [F.coalesce(F.col(s) / GRAIN, F.lit(0.0)) for s in names]
    all_times = sum(times[1:], times[0])
    ratio = [(F.col("n") + ADD) / below * (t + calm * float(m)) / ((all_times + calm) * float(m)) for t, m in zip(times, marginal)]
    with owned(made):
        learned = stage(words.join(sums, "i", "left").select("i", *(r.alias(s) for r, s in zip(ratio, names))), "lm-emissions")
    whole_of = learned.agg(*(F.coalesce(F.sum(s), F.lit(0.0)) for s in names)).first()
    scale = (1 - unseen) / (emit.sum(0) + np.array(whole_of, float))
    emit *= scale
    emit[n - 1] /= max(once, 1)  # of one word of the class
    of = Model.of(counts, prior, states)
    learned = learned.select("i", *((F.col(s) * float(x)).cast("float").alias(s) for s, x in zip(names, scale)))
    return Model(of.start, of.move, np.r_[emit, np.full((1, states), unseen)]), learned, made
