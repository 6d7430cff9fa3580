"""Scoring texts with a causal self-attention model on subword ids, trained in numpy.

Ids are the pieces of a public vocabulary, each with a mark for the last piece of its word, so
the ids of a word end by themselves. For each id a query of the id before it attends to keys of up
to CONTEXT + STEP ids before; what it gathers weighs EXPERTS distributions of the id given the one
before. An expert has a weight for each of the PAIRS most frequent pairs of
ids in the training texts, and a distribution over single ids for the rest, so that the
probabilities of all ids sum to one without a sum over the vocabulary. Nothing else has a part in
the score.

All windows of every training document take part: their pairs are counted, and in each round every
partition goes through its windows by gradient steps on the attention and the weights of experts,
and counts how much each expert explains of each id and pair; changes are averaged and counts
summed in a tree of tasks. The experts start from topics of the counts of all those pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, hold, release, slices
from .workspace import keep, ship

CONTEXT, STEP = 16, 16
WIDTH, EXPERTS, DIM = CONTEXT + STEP, 8, 8
ROUNDS = 1
#: Pairs of ids that have weights of their own.
PAIRS = 1 << 19
#: Windows that are read at a time.
READ = 4096
#: Words whose counts are at hand in each task.
FREQUENT = 1 << 20
CACHE = 300_000
BATCH = 512
#: Pairs whose topics are looked at at once.
TOPIC = 1 << 16
#: Windows that are scored at a time.
SCORED = 256
#: Bytes of ids for a task of training.
TASK = 8 << 20
_PARTS = 8


class Subwords:
    """Ids of words: 2 * piece, plus one for the last piece of a word; then end, start and
    padding."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = 2 * self.model.get_piece_size()
        self.start, self.pad, self.size = self.end + 1, self.end + 2, self.end + 3
        self.clear()

    def clear(self) -> None:
        """Forget all words: known has the place of each in at, at + 1 the ends of its ids in flat."""
        self.known: dict[int, int] = {}
        self.at, self.flat, self.n = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint16), 0

    def learn(self, hashes: list[int], words: list[bytes]) -> None:
        found = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, sizes.sum()) * 2
        if not sizes.all():  # a word without pieces is one unknown piece
            ids = np.insert(ids, np.cumsum(sizes)[sizes == 0], 0)
            sizes = np.maximum(sizes, 1)
        ends = np.cumsum(sizes)
        ids[ends - 1] += 1
        while self.n + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.n : self.n + len(ids)] = ids
        self.known.update(zip(hashes, range(len(self.known), len(self.known) + len(hashes))))
        self.at = np.concatenate([self.at, self.n + ends])
        self.n += len(ids)

    def of(self, words: Words, unique: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct words after each other, and their n + 1 offsets."""
        if len(self.known) > CACHE:
            self.clear()
        hashes = unique.tolist()
        place = np.fromiter(map(self.known.get, hashes, itertools.repeat(-1)), np.int64, len(hashes))
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = words.data.tobytes()
            at, to = words.start[first[new]].tolist(), words.end[first[new]].tolist()
            place[new] = len(self.known) + np.arange(len(new))
            self.learn(unique[new].tolist(), [raw[s:e].lower() for s, e in zip(at, to)])
        sizes = self.at[place + 1] - self.at[place]
        offsets = np.r_[0, np.cumsum(sizes)]
        return self.flat[np.arange(offsets[-1]) + np.repeat(self.at[place] - offsets[:-1], sizes)].astype(np.int64), offsets


class Stream:
    """The ids of a batch of texts, each with an end, and the words that they belong to. Words
    are counted through all texts; a text's end is a word of its own."""

    def __init__(self, texts: pa.Array, subwords: Subwords):
        words = Words(texts)
        self.words = words
        self.unique, first, self.place = np.unique(words.hashes(True), return_index=True, return_inverse=True)
        flat, offsets = subwords.of(words, self.unique, first)
        n_words = words.counts()
        docs = len(n_words)
        # Words with the ends of texts in between: the end stands after the text's last word.
        slot = np.arange(len(words)) + np.repeat(np.arange(docs), n_words)
        ends = words.at[1:] + np.arange(docs)
        sizes = np.ones(len(words) + docs, np.int64)
        own = np.diff(offsets)[self.place]
        sizes[slot] = own
        self.word_at = np.r_[0, np.cumsum(sizes)]
        self.ids = np.full(self.word_at[-1], subwords.end, np.int64)
        source = np.repeat(offsets[self.place] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        target = np.repeat(self.word_at[slot] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        self.ids[target] = flat[source]
        self.doc_at = self.word_at[np.r_[0, ends + 1]]
        lengths = np.diff(self.doc_at)
        self.n_windows = -(-lengths // STEP)
        padded = CONTEXT + 1 + STEP * self.n_windows
        begin = np.r_[0, np.cumsum(padded)]
        line = np.full(begin[-1], subwords.pad, np.int64)
        for k in range(CONTEXT + 1):
            line[begin[:-1] + k] = subwords.start
        owner = np.repeat(np.arange(docs), lengths)
        line[begin[:-1][owner] + CONTEXT + 1 + np.arange(len(self.ids)) - self.doc_at[:-1][owner]] = self.ids
        self.line, self.begin = line, begin

    def windows(self, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Windows of WIDTH + 1 ids: the last STEP are those to be predicted."""
        return self.line[(self.begin[doc] + STEP * number)[:, None] + np.arange(WIDTH + 1)]


class Rows:
    """Rows of keys (uint32, distinct): tables of slots, each for the keys that the ones before it
    have no room for."""

    def __init__(self, keys: np.ndarray):
        self.n, self.tables = len(keys), []
        left = np.arange(self.n)
        while len(left):
            bits = max(int(4 * len(left)).bit_length(), 4)
            # Another odd factor for each table.
            factor, shift = np.uint32(0x9E3779B1 + 2 * 0x3C6EF372 * len(self.tables) & 0xFFFFFFFF), np.uint32(32 - bits)
            slot = keys[left] * factor >> shift
            row = np.full(1 << bits, -1, np.int32)
            row[slot] = left
            own = np.where(row >= 0, keys[row], 0).astype(np.uint32)
            self.tables.append((factor, shift, own, row))
            left = left[row[slot] != left]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, n for those that have none."""
        out = np.full(keys.shape, self.n, np.int32)
        ask = None
        for factor, shift, own, row in self.tables:
            some = keys if ask is None else keys[ask]
            slot = some * factor >> shift
            found = row.take(slot)
            hit = (own.take(slot) == some) & (found >= 0)
            if ask is None:
                np.copyto(out, found, where=hit)
                ask = np.flatnonzero(~hit)
            else:
                out[ask[hit]] = found[hit]
                ask = ask[~hit]
            if not len(ask):
                break
        return out


class Model:
    """The parameters, as float32 arrays. pairs: keys of the pairs of ids that have weights, in
    order; weights: a row for each, and one of zeros; single: the experts' distributions over ids;
    rest: by the id before, the experts' shares that single gets. small: what queries and keys
    multiply to, values, and what a distance counts."""

    def __init__(self, size: int, start: int, pad: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.size, self.start, self.pad = size, start, pad
        self.embed = draw(size, DIM, scale=0.3)
        self.small = {"qk": draw(DIM, DIM, scale=0.03), "v": draw(DIM, EXPERTS, scale=0.1), "bias": np.linspace(0, -1, WIDTH).astype(np.float32)}
        self.pairs = np.zeros(0, np.uint32)
        self.rows = None
        self.ratio = np.ones(size, np.float32)
        self.weights = np.zeros((1, EXPERTS), np.float32)
        self.single = np.full((size, EXPERTS), 1.0 / size, np.float32)
        self.rest = np.ones((size, EXPERTS), np.float32)
        reach = CONTEXT + np.arange(STEP)[:, None] - np.arange(WIDTH)[None, :]
        self.reach, self.hidden = np.clip(reach, 0, WIDTH - 1), reach < 0

    def copy(self) -> Model:
        """One that can be trained without changing this one."""
        own = Model.__new__(Model)
        own.__dict__.update(self.__dict__)
        own.embed, own.small = self.embed.copy(), {k: v.copy() for k, v in self.small.items()}
        return own

    def __getstate__(self):
        return {**self.__dict__, "rows": None}

    def row(self, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The row of weights of each pair."""
        if self.rows is None:
            self.rows = Rows(self.pairs)
        return self.rows.of(last.astype(np.uint32) * np.uint32(self.size) + target.astype(np.uint32))

    def normalise(self, pairs: np.ndarray, other: np.ndarray) -> None:
        """Experts from how much each explains of the pairs that have weights, and of the ids of all
        others; no id is impossible. ratio says of the id before how much of its mass is for pairs
        without weights, or never seen."""
        pairs, single = pairs.astype(np.float64), other.astype(np.float64)
        last, target = (self.pairs // np.uint32(self.size)).astype(np.int64), (self.pairs % np.uint32(self.size)).astype(np.int64)
        sums = lambda ids: np.stack([np.bincount(ids, pairs[:, e], self.size) for e in range(EXPERTS)], 1)
        single = single + sums(target)
        nothing = [self.pad, self.start]  # nobody predicts padding or start
        overall = single.sum(1) + 0.05
        overall[nothing] = 0
        overall /= overall.sum()
        single[nothing] = 0
        smooth = single + overall[:, None] * (0.02 * single.sum(0) / EXPERTS + 20.0)
        self.single = (smooth / smooth.sum(0)).astype(np.float32)
        total = sums(last)
        free = (total + 0.5) * self.ratio[:, None].astype(np.float64)
        self.rest = (free / (total + free)).astype(np.float32)
        self.weights = np.zeros((len(last) + 1, EXPERTS), np.float32)
        self.weights[:-1] = pairs / (total + free)[last]

    def experts(self, last: np.ndarray, target: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Each expert's probability of target after last."""
        out = self.rest.take(last, 0)
        out *= self.single.take(target, 0)
        out += self.weights.take(row, 0)
        return out

    def prepare(self) -> None:
        """Bound the length of queries so that no exponential is infinite, also after some steps."""
        self.longest = np.float32(50 / (np.sqrt(((self.embed * self.embed) @ _ONES).max()) + 1e-6))

    def forward(self, windows: np.ndarray):
        """All of a batch: places in windows are rows of the first axis, or of the first two. Sums
        over a short axis are products with ones, which are faster."""
        before, target = windows[:, :WIDTH], windows[:, CONTEXT + 1 :].reshape(-1)
        last = np.ascontiguousarray(before[:, CONTEXT:]).reshape(-1)
        n = len(windows)
        x = self.embed.take(before, 0)
        own = self.embed.take(last, 0)
        query = own @ self.small["qk"]
        length = np.sqrt((query * query) @ _ONES)
        query *= np.minimum(self.longest / (length + np.float32(1e-9)), np.float32(1))[:, None]
        weights = query.reshape(n, STEP, DIM) @ x.transpose(0, 2, 1)
        np.exp(weights, out=weights)
        weights *= np.where(self.hidden, np.float32(0), np.exp(self.small["bias"], dtype=np.float32)[self.reach])
        total = weights.reshape(-1, WIDTH) @ _WIDE
        seen = (weights @ x).reshape(-1, DIM)
        seen /= total[:, None]
        gate = seen @ self.small["v"]
        np.clip(gate, np.float32(-60), np.float32(60), out=gate)
        np.exp(gate, out=gate)
        gate /= (gate @ _EACH)[:, None]
        row = self.row(last, target)
        explained = self.experts(last, target, row)
        explained *= gate
        prob = np.maximum(explained @ _EACH, np.float32(1e-30))
        return before, target, row, x, own, query, weights, total, seen, gate, explained, prob

    def score(self, windows: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the STEP last ids of each window."""
        self.prepare()
        parts = [np.log(self.forward(windows[i : i + SCORED])[-1]).reshape(-1, STEP) for i in range(0, len(windows), SCORED)]
        return np.concatenate(parts) if parts else np.zeros((0, STEP), np.float32)

    def train(self, windows: np.ndarray, squares: dict, rate: float = 0.3) -> tuple[float, np.ndarray, np.ndarray]:
        """A gradient step on a batch: the sum of the logarithms, the row of each pair and what the
        experts explain of it."""
        before, target, row, x, own, query, weights, total, seen, gate, explained, prob = self.forward(windows)
        real = (target != self.pad).astype(np.float32)
        explained *= (real / prob)[:, None]
        n, s = max(float(real.sum()), 1.0), self.small
        d_gate = gate * real[:, None] - explained
        d_seen = d_gate @ s["v"].T
        inner = (d_seen * seen) @ _ONES
        deep = d_seen.reshape(-1, STEP, DIM)
        weights /= total.reshape(-1, STEP, 1)
        d_scores = deep @ x.transpose(0, 2, 1)
        d_scores -= inner.reshape(-1, STEP, 1)
        d_scores *= weights
        d_query = (d_scores @ x).reshape(-1, DIM)
        d_x = weights.transpose(0, 2, 1) @ deep
        d_x += d_scores.transpose(0, 2, 1) @ query.reshape(-1, STEP, DIM)
        d_x[:, CONTEXT:] += (d_query @ s["qk"].T).reshape(-1, STEP, DIM)
        grads = {"v": seen.T @ d_gate, "qk": own.T @ d_query, "bias": np.bincount(self.reach.reshape(-1), d_scores.sum(0).reshape(-1), minlength=WIDTH).astype(np.float32)}
        for name, g in grads.items():
            g = g / n
            squares[name] = squares.get(name, 0) + g * g
            s[name] -= (rate * 0.2 * g / (np.sqrt(squares[name]) + 1e-8)).astype(np.float32)
        rows, g = _sum_rows(before.reshape(-1).astype(np.uint16), d_x.reshape(-1, DIM))
        g /= np.float32(n)
        square = squares.setdefault("embed", np.zeros(self.size, np.float32))
        square[rows] += (g * g) @ _ONES / DIM
        self.embed[rows] -= np.float32(rate * 0.3) * g / (np.sqrt(square[rows]) + 1e-8)[:, None]
        squares.setdefault("seen", np.zeros(self.size, np.float32))[rows] += 1
        return float(np.log(prob) @ real), row, explained


_ONES, _EACH, _WIDE = np.ones(DIM, np.float32), np.ones(EXPERTS, np.float32), np.ones(WIDTH, np.float32)


def _sum_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable" if ids.itemsize == 2 else None)  # stable ones of 16 bits count
    ids = ids[order]
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[start].astype(np.int64), np.add.reduceat(rows.take(order, 0), start, axis=0)


def _add_rows(total: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    ids, rows = _sum_rows(ids, rows)
    total[ids] += rows


def topics(last: np.ndarray, target: np.ndarray, counts: np.ndarray, size: int, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Distributions over ids of EXPERTS topics of pairs of ids and their counts: a mixture by
    expectation-maximisation in which both ids of a pair are of its topic; (size, EXPERTS)."""
    rng = np.random.default_rng(seed)
    if not len(counts):
        return np.full((size, EXPERTS), 1.0 / size)
    prob, weight = rng.dirichlet(np.ones(EXPERTS), size) / size, np.full(EXPERTS, 1.0 / EXPERTS)
    for _ in range(rounds):
        sums = np.zeros((size, EXPERTS))
        for i in range(0, len(counts), TOPIC):
            a, b = last[i : i + TOPIC], target[i : i + TOPIC]
            share = prob.take(a, 0) * prob.take(b, 0) * weight
            share *= (counts[i : i + TOPIC] / share.sum(1))[:, None]
            for e in range(EXPERTS):
                sums[:, e] += np.bincount(a, share[:, e], size) + np.bincount(b, share[:, e], size)
        weight = (sums.sum(0) + 1e-9) / (sums.sum() + EXPERTS * 1e-9)
        overall = sums.sum(1, keepdims=True) / sums.sum()
        prob = sums + (overall + 1e-9) * (1.0 + 0.02 * sums.sum(0))
        prob /= prob.sum(0)
    return prob


def _lines(stream: Stream):
    """The ids of all windows, those that windows share only once: a line for each text."""
    line = stream.line.astype(np.uint16)
    return [line[a:z].tobytes() for a, z in zip(stream.begin[:-1].tolist(), stream.begin[1:].tolist())]


class Counts:
    """Counts by 64-bit key, added up now and then, and let go beyond LARGE keys."""

    MERGE, LARGE = 1 << 20, 1 << 21

    def __init__(self):
        self.parts, self.waiting = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting < self.MERGE:
            return None
        keys, counts = self.merged()
        if len(keys) > self.LARGE:
            self.parts, self.waiting = [], 0
            return keys, counts
        # What is merged counts as waiting again only when as much has come as there is.
        self.parts, self.waiting = [(keys, counts)], -min(len(keys), self.MERGE)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys)
        keys = keys[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return keys[start], np.add.reduceat(counts[order], start) if len(start) else counts


def _gather(path: str):
    """Of the partition's training texts counts of the words and of the pairs of ids; of each text
    how many tokens it has, and the line of all its windows."""

    def run(batches):
        hold()
        subwords = Subwords(path)
        n_docs, kept = 0, {"word": Counts(), "pair": Counts()}
        for batch in batches:
            for b in slices(batch, "text"):
                stream = Stream(b.column("text"), subwords)
                learned = ~b.column("held_out").to_numpy(zero_copy_only=False)
                n_docs += int(learned.sum())
                words = np.bincount(stream.place[np.repeat(learned, stream.words.counts())], minlength=len(stream.unique))
                before = np.r_[subwords.start, stream.ids[:-1]]
                before[stream.doc_at[:-1]] = subwords.start
                pairs = np.unique((before * subwords.size + stream.ids)[np.repeat(learned, np.diff(stream.doc_at))], return_counts=True)
                found = {"word": (stream.unique[words > 0], words[words > 0]), "pair": (pairs[0].astype(np.uint64), pairs[1])}
                for name, counts in kept.items():
                    if full := counts.add(*found[name]):
                        yield _gathered(**{name: full[0].view(np.int64), "n": full[1]})
                yield _gathered(key=b.column("key"), id=b.column("id"), learned=learned, n=stream.words.counts() + 1, line=pa.array(_lines(stream), pa.binary()))
        for name, counts in kept.items():
            keys, n = counts.merged()
            yield _gathered(**{name: keys.view(np.int64), "n": n})
        if n_docs:
            yield _gathered(n_docs=np.array([n_docs]))
        del subwords, kept
        release()

    return run


_GATHERED = pa.schema([("word", pa.int64()), ("pair", pa.int64()), ("n_docs", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("learned", pa.bool_()), ("line", pa.binary())])
_GATHERED_DDL = "word long, pair long, n_docs long, n long, key long, id long, learned boolean, line binary"


def _gathered(**columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _GATHERED], schema=_GATHERED)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a, np.float32).tobytes(), 1)


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.float32)


def _windows(lines):
    """All windows of lines, at most READ at a time, and the lines that they are of."""
    waiting, owners, n = [], [], 0
    for i, raw in enumerate(lines):
        every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw.as_buffer(), np.uint16), WIDTH + 1)[::STEP]
        while len(every):
            own, every = every[: READ - n], every[READ - n :]
            waiting.append(own)
            owners.append(np.full(len(own), i))
            n += len(own)
            if n == READ:
                yield np.concatenate(waiting).astype(np.int64), np.concatenate(owners)
                waiting, owners, n = [], [], 0
    if n:
        yield np.concatenate(waiting).astype(np.int64), np.concatenate(owners)


def _train(model: Model, windows: np.ndarray, squares: dict, pairs: np.ndarray, other: np.ndarray) -> tuple[float, int]:
    """Steps through windows; adds to counts; the sum of the logarithms, and how many steps."""
    log, rows, shares = 0.0, [], []
    model.prepare()
    for i in range(0, len(windows), BATCH):
        own, row, explained = model.train(windows[i : i + BATCH], squares)
        log += own
        rows.append(row)
        shares.append(explained)
    rows, shares = np.concatenate(rows), np.concatenate(shares)
    _add_rows(pairs, rows, shares)
    without = np.flatnonzero(rows == len(model.pairs))
    if len(without):
        _add_rows(other, windows[:, CONTEXT + 1 :].reshape(-1)[without], shares[without])
    return log, -(-len(windows) // BATCH)


def _round(shared):
    """A partition's share of a round: sums of changes by how often a row changed, how often, and
    what the experts explained."""

    def run(batches):
        hold()
        model = shared.value
        own = model.copy()
        pairs, other = np.zeros(model.weights.shape, np.float32), np.zeros(model.single.shape, np.float32)
        squares, n = {}, 0
        for windows, _ in (w for b in batches for w in _windows(b.column(0))):
            n += _train(own, windows, squares, pairs, other)[1]
        if not n:
            return
        seen = squares["seen"]
        out = {"pairs": pairs, "other": other, "n": np.array([n], np.float32), "embed": (own.embed - model.embed) * seen[:, None], "seen": seen}
        out |= {f"small_{k}": (v - model.small[k]) * n for k, v in own.small.items()}
        for name, a in out.items():
            for k, part in enumerate(np.array_split(a, _PARTS) if len(a) > WIDTH else [a]):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([_pack(part)])], names=["name", "part", "data"])
        del own, pairs, other, squares, out
        release()

    return run


_SUMS = "name string, part int, data binary"


def _add(batches):
    total: dict = {}
    for b in batches:
        for name, part, data in zip(*(c.to_pylist() for c in b.columns)):
            a = _array(data)
            total[name, part] = total[name, part] + a if (name, part) in total else a
    for (name, part), a in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([_pack(a)])], names=["name", "part", "data"])


def _tree_sum(rows: DataFrame) -> dict[str, np.ndarray]:
    """Arrays by name, summed over all tasks eight at a time; the driver gets at most four of each."""
    rows = keep(rows, "round")
    tasks = rows.rdd.getNumPartitions()
    while tasks > 4:
        tasks = -(-tasks // 8)
        # Shares of the same number meet, whatever partition they come from.
        share = F.pmod(F.spark_partition_id(), F.lit(tasks))
        rows = keep(rows.withColumn("share", share).repartition(tasks * _PARTS, "share", "part").drop("share").mapInArrow(_add, _SUMS), "sums")
    out: dict = {}
    for r in rows.toLocalIterator():
        a = _array(bytes(r.data))
        out[r.name, r.part] = out[r.name, r.part] + a if (r.name, r.part) in out else a
    names = {name for name, _ in out}
    return {name: np.concatenate([out[name, k] for k in sorted(p for m, p in out if m == name)]) for name in names}


def _largest(counts: DataFrame, key: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` keys, in order, and their counts: all above the least count that so few
    reach, where counts are told apart by sixteenths of a power of two."""
    level = F.floor(F.log2("n") * 16)
    by_level = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).toArrow()
    above = np.cumsum(by_level.column("k").to_numpy())
    last = int(np.searchsorted(above, most, "right")) - 1
    at_least = by_level.column("level")[max(last, 0)].as_py() if len(above) else 0
    # Of a highest level that alone has too many, any will do.
    table = counts.where(level >= at_least).limit(most).toArrow()
    found, n = table.column(key).to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def begin(model: Model, pairs: np.ndarray, counts: np.ndarray, of: np.ndarray, total: np.ndarray, types: np.ndarray) -> None:
    """Where a model starts from: pairs that get weights and their counts; of an id before (of), how
    often it is one and with how many ids after it. Topics of the pairs divide the counts among the
    experts."""
    model.pairs = pairs.astype(np.uint32)
    last, target = (pairs // np.uint64(model.size)).astype(np.int64), (pairs % np.uint64(model.size)).astype(np.int64)
    topic = topics(last, target, counts, model.size)
    with_weights = np.bincount(last, counts, model.size)
    rest, kinds = np.zeros(model.size), np.zeros(model.size)
    rest[of], kinds[of] = total, types
    rest -= with_weights
    # What was never seen gets a share by how many different ids have been.
    model.ratio = ((rest + 0.2 * kinds + 0.5) / (with_weights + 1)).astype(np.float32)
    share = topic[last] * topic[target]
    model.normalise(share / share.sum(1, keepdims=True) * counts[:, None], np.zeros((model.size, EXPERTS)))
    # Of what an id says about topics its embedding starts, and values pass it on.
    log = np.log(topic + 0.01 * topic.mean(1, keepdims=True) + 1e-9)
    model.embed = np.zeros((model.size, DIM), np.float32)
    model.embed[:, :EXPERTS] = (log - log.mean(1, keepdims=True))[:, :DIM] / 2
    model.embed[[model.start, model.pad]] = 0
    model.small["v"] = 8 * np.eye(DIM, EXPERTS, dtype=np.float32)


def fit(lines: DataFrame, pairs: DataFrame, path: str) -> Model:
    """The model after ROUNDS rounds over all windows of lines (line binary); pairs: (pair, n)."""
    spark = lines.sparkSession
    subwords = Subwords(path)
    model = Model(subwords.size, subwords.start, subwords.pad)
    found = _largest(pairs, "pair", PAIRS)
    last = F.expr(f"pair div {model.size}").alias("last")
    lasts = pairs.groupBy(last).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toArrow()
    begin(model, *found, *(lasts.column(c).to_numpy() for c in ("last", "n", "k")))
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK)
    for _ in range(ROUNDS if size else 0):
        sums = _tree_sum(lines.coalesce(tasks).mapInArrow(_round(spark.sparkContext.broadcast(model)), _SUMS))
        model.embed = model.embed + sums["embed"].reshape(-1, DIM) / np.maximum(sums["seen"], 1)[:, None]
        for name, a in model.small.items():
            model.small[name] = a + sums[f"small_{name}"].reshape(a.shape) / sums["n"][0]
        model.normalise(sums["pairs"].reshape(-1, EXPERTS)[:-1], sums["other"].reshape(-1, EXPERTS))
    return model


def _score(shared):
    """The score of each line."""

    def run(batches):
        hold()
        model = shared.value
        for b in batches:
            score = np.zeros(len(b))
            for windows, of in _windows(b.column("line")):
                logs = np.where(windows[:, CONTEXT + 1 :] != model.pad, model.score(windows), 0).sum(1, dtype=np.float64)
                score += np.bincount(of, logs, len(b))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), b.column("n"), pa.array(score / np.log(10))], names=["key", "id", "n_tokens", "score"])
        release()

    return run


def _base(shared, total: int, distinct: int):
    """A row for each text with the base score of its words at hand, and one for each of its other
    words, whose counts come by a join."""

    def run(batches):
        words, counts = shared.value
        floor = np.log10(total + distinct + 1.0)
        for batch in batches:
            for b in slices(batch, "text"):
                own = Words(b.column("text"))
                docs = len(b)
                unique, place = np.unique(own.hashes(True), return_inverse=True)
                if len(words):
                    i = np.minimum(np.searchsorted(words, unique), len(words) - 1)
                    found = words[i] == unique
                    each = np.where(found, np.log10(counts[i] + 1.0) - floor, 0.0)
                else:
                    found, each = np.zeros(len(unique), bool), np.zeros(len(unique))
                of = np.repeat(np.arange(docs), own.counts())
                base, known = np.bincount(of, each[place], docs), np.bincount(of, found[place], docs)
                rare = np.flatnonzero(~found[place])
                code, times = np.unique(of[rare] * (len(unique) + 1) + place[rare], return_counts=True)
                of, word = code // (len(unique) + 1), unique[code % (len(unique) + 1)]
                m, take = len(of), pa.array(of)
                none = lambda n, kind: pa.nulls(n, kind)
                keys, ids = b.column("key"), b.column("id")
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([keys, keys.take(take)]), pa.concat_arrays([ids, ids.take(take)]),
                    pa.concat_arrays([pa.array(known.astype(np.int64)), none(m, pa.int64())]),
                    pa.concat_arrays([pa.array(base), none(m, pa.float64())]),
                    pa.concat_arrays([none(docs, pa.int64()), pa.array(word.view(np.int64))]),
                    pa.concat_arrays([none(docs, pa.int64()), pa.array(times)]),
                ], names=["key", "id", "known", "base", "word", "times"])

    return run


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: crc32 of the id as text leaves ``part`` modulo parts; all others are learned from,
    whole. Tokens are words in which A-Z are a-z, then one end. base_score adds log10 of
    (c + 1) / (N + V + 1) over tokens, score is the model's log10 probability. Null texts are
    empty: one token, the end. Rows that repeat come out alike and are learned from as often as
    they occur; a null id counts as an empty text of an id; without training rows every count is
    0; an empty table gives an empty one. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    gathered = keep(rows.mapInArrow(_gather(path), _GATHERED_DDL), "gathered")
    words = keep(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = keep(gathered.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    n_words, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_docs = gathered.agg(F.sum("n_docs")).first()[0] or 0
    total, distinct = (n_words or 0) + n_docs, distinct + (n_docs > 0)
    floor = float(np.log10(total + distinct + 1.0))

    model = fit(gathered.where("learned").select("line"), pairs, path)
    scored = gathered.where("line is not null").select("key", "id", "n", "line").mapInArrow(_score(spark.sparkContext.broadcast(model)), "key long, id long, n_tokens long, score double")
    base = rows.select("key", "id", "text").mapInArrow(_base(spark.sparkContext.broadcast(_largest(words, "word", FREQUENT)), total, distinct), "key long, id long, known long, base double, word long, times long")
    base = keep(base, "base")
    # Rows that repeat have each word once, and one score.
    rare = base.where("word is not null").select("key", "id", "word", "times").dropDuplicates(["key", "id", "word"]).join(words, "word", "left")
    more = F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(floor))
    rare = rare.groupBy("key", F.struct("id").alias("own")).agg(F.sum(more).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("also"))
    scored = scored.select("key", F.struct("id").alias("own"), "n_tokens", "score").dropDuplicates(["key", "own"])
    out = base.where("word is null").select("key", F.struct("id").alias("own"), "known", "base").join(scored, ["key", "own"]).join(rare, ["key", "own"], "left")
    return out.withColumn("id", F.col("own.id")).select(
        F.col("id").alias(id_col), (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % parts == part).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(n_docs + 1.0)) - floor)).alias("base_score"), "score",
    )
