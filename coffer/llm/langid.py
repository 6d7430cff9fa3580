"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. A character that is no piece has a probability by how often a language has
such ones. The probabilities are learned by expectation-maximisation on a bounded sample of labelled
rows; every text is scored whole.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, powers, release, slices
from .workspace import ship

#: Labelled rows of each language that the model is fitted to, and bytes of their texts, about and at
#: most; chosen by a hash of the id.
SAMPLE, SAMPLE_BYTES = 1500, 8_000_000
ROUNDS = 2
#: Words up to here are scored in plain numbers, longer ones in logarithms, and learned from in
#: stretches of so many characters.
PLAIN = 36
#: The probability of one character among those that are no pieces.
UNKNOWN = 1e-4
#: Word scores that a worker keeps.
CACHE = 400_000
MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(path: str) -> list[str]:
    """Pieces in lower case, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p})


def _codes(words: list[str]) -> np.ndarray:
    """A matrix of the characters of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows."""
    n = codes.shape[1]
    total = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), axis=1, out=total[:, 1:])
    return total


class Pieces:
    """Finds pieces in words: a table of hashes, each slot with its piece or the next one's."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        hashes = np.zeros(self.n, np.uint64)
        self.lengths = sorted({1, *map(len, pieces)})
        for length in sorted({len(p) for p in pieces}):
            of = [i for i, p in enumerate(pieces) if len(p) == length]
            hashes[of] = mix(_hash(_codes([pieces[i] for i in of]))[:, -1] + np.uint64(length))
        self.order = np.argsort(hashes).astype(np.int64)
        self.hashes = hashes[self.order]
        self.back = powers(pow(_BASE, -1, 1 << 64), 1 << 17)

    def at(self, total: np.ndarray, start: int, end: int) -> np.ndarray:
        """The piece from start to end of each word, or -1."""
        back = self.back[start] if start < len(self.back) else np.uint64(pow(pow(_BASE, -1, 1 << 64), start, 1 << 64))
        h = mix((total[:, end] - total[:, start]) * back + np.uint64(end - start))
        i = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
        return np.where(self.hashes[i] == h, self.order[i], -1)


def _by_length(words: list[str]):
    of: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        of.setdefault(len(w), []).append(i)
    for length, rows in of.items():
        step = max(1, 400_000 // max(length, 1))
        for k in range(0, len(rows), step):
            yield length, rows[k : k + step]


def word_scores(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the words' probabilities in each language. prob has a row for each piece and
    a last one for a character that isn't a piece."""
    out = np.zeros((len(words), prob.shape[1]))
    log = np.log(prob)
    for length, rows in _by_length(words):
        total = _hash(_codes([words[i] for i in rows]))
        plain = length <= PLAIN
        ahead = [np.full((len(rows), prob.shape[1]), 1.0 if plain else 0.0)]
        for end in range(1, length + 1):
            now = np.zeros_like(ahead[0]) if plain else np.full_like(ahead[0], -np.inf)
            for start in (end - n for n in pieces.lengths if n <= end):
                piece = pieces.at(total, start, end)
                before = ahead[start - end]
                if end - start > 1:
                    hit = np.flatnonzero(piece >= 0)
                    if not len(hit):
                        continue
                    if plain:
                        now[hit] += before[hit] * prob[piece[hit]]
                    else:
                        now[hit] = np.logaddexp(now[hit], before[hit] + log[piece[hit]])
                elif plain:
                    now += before * prob[piece]
                else:
                    now = np.logaddexp(now, before + log[piece])
            ahead.append(now)
            if len(ahead) > pieces.lengths[-1]:
                del ahead[0]
        out[rows] = np.log(ahead[-1]) if plain else ahead[-1]
    return out


def _expected(words: list[str], counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in one language, and of characters that are none, by the
    forward-backward algorithm; words of at most PLAIN characters."""
    out = np.zeros(pieces.n + 1)
    for length, rows in _by_length(words):
        total = _hash(_codes([words[i] for i in rows]))
        spans = [(s, e, pieces.at(total, s, e)) for e in range(1, length + 1) for s in (e - n for n in reversed(pieces.lengths) if n <= e)]
        weight = {(s, e): np.where((p >= 0) | (e - s == 1), prob[p], 0.0) for s, e, p in spans}
        ahead, behind = np.zeros((length + 1, len(rows))), np.zeros((length + 1, len(rows)))
        ahead[0] = behind[length] = 1.0
        for s, e, _ in spans:
            ahead[e] += ahead[s] * weight[s, e]
        for s, e, _ in reversed(spans):
            behind[s] += behind[e] * weight[s, e]
        share = counts[rows] / ahead[length]
        for s, e, p in spans:
            np.add.at(out, p, ahead[s] * weight[s, e] * behind[e] * share)
    return out


def fit(words: dict[str, dict[str, int]], pieces: Pieces) -> tuple[list[str], np.ndarray]:
    """Languages in order and the probability of every piece in each, from word counts."""
    languages = sorted(words)
    columns = []
    for language in languages:
        stretches: dict[str, int] = {}
        for w, n in words[language].items():
            for k in range(0, len(w), PLAIN):
                stretches[w[k : k + PLAIN]] = stretches.get(w[k : k + PLAIN], 0) + n
        own = list(stretches)
        counts = np.array([stretches[w] for w in own], float)
        prob = np.full(pieces.n + 1, 1.0 / (pieces.n + 1))
        for _ in range(ROUNDS):
            prob[-1] *= UNKNOWN
            seen = _expected(own, counts, pieces, prob) + 0.01
            prob = seen / seen.sum()
        prob[-1] *= UNKNOWN
        columns.append(prob)
    return languages, np.stack(columns, 1) if columns else np.zeros((pieces.n + 1, 0))


def _word(raw: bytes) -> str:
    return MARK + raw.decode("utf-8", "replace").lower()


def _count(batches):
    """Word counts by language of a bounded number of rows."""
    total: dict[str, dict[str, int]] = {}
    for b in batches:
        for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = total.setdefault(language, {})
            for w in (text or "").encode().split():
                own[w] = own.get(w, 0) + 1
    for language, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(own)), pa.array([w.decode() for w in own]), pa.array(list(own.values()), pa.int64())], names=["language", "word", "n"])


def learn(labelled: DataFrame, path: str, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """fit() to a sample of about SAMPLE rows of each label, the same in every run."""
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("rows"), F.lit(float(SAMPLE_BYTES)) / F.greatest("bytes", F.lit(1)))
    sample = labelled.join(F.broadcast(counts), "label")
    sample = sample.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 62)).cast("double") < share * float(1 << 62))
    rows = sample.select("label", "text").mapInArrow(_count, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {}
    for row in rows.toLocalIterator():
        own, w = words.setdefault(row.language, {}), _word(row.word.encode())
        own[w] = own.get(w, 0) + row.n
    return fit({k: v for k, v in words.items() if any(v)}, Pieces(vocabulary(path)))


def _predict(path: str, languages: list[str], prob: np.ndarray):
    def run(batches):
        pieces = Pieces(vocabulary(path))
        known: dict[int, int] = {}
        scores = np.zeros((CACHE + 1, max(len(languages), 1)))
        for batch in batches:
            for b in slices(batch, 1):
                texts = b.column(1)
                words = Words(texts)
                unique, first, place = np.unique(words.hashes(True), return_index=True, return_inverse=True)
                if len(known) + len(unique) > CACHE:
                    known.clear()
                if len(unique) > CACHE:
                    scores = np.zeros((len(unique) + 1, scores.shape[1]))
                rows = np.array([known.get(h, -1) for h in unique.tolist()], np.int64)
                new = np.flatnonzero(rows < 0)
                if len(new) and languages:
                    raw = words.data.tobytes()
                    at, to = words.start[first[new]].tolist(), words.end[first[new]].tolist()
                    # The next free rows of the table, in the order of the new words.
                    free = len(known) + np.arange(len(new))
                    scores[free] = word_scores([_word(raw[s:e]) for s, e in zip(at, to)], pieces, prob)
                    known.update(zip(unique[new].tolist(), free.tolist()))
                    rows[new] = free
                best, score = ["und"] * len(b), np.zeros(len(b))
                total = np.vstack([np.zeros(scores.shape[1]), scores[rows][place]]) if len(unique) and languages else np.zeros((1, scores.shape[1]))
                counts = words.counts()
                for i, text in enumerate(texts.to_pylist()):
                    if languages and text and counts[i] and _LETTER.search(text):
                        own = total[words.at[i] + 1 : words.at[i + 1] + 1].sum(0)
                        share = np.exp(own - own.max())
                        k = int(np.argmax(own))
                        best[i], score[i] = languages[k], share[k] / share.sum()
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(best, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
        del known, scores
        release()

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; und with score 0 if it is null or has no letter.
    Of languages that score alike the first by name is taken. Only id and text are read."""
    ship(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_predict(path, *model), "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str, parts: int = 3, part: int = 1):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part, F.lit(False))


def language_id(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    The model is learned from labelled rows that aren't held out; label, source and id are no
    inputs of a prediction. Without any labelled row all is und. Rows that repeat come out alike;
    an empty table gives an empty one; null ids stay null and aren't held out.
    """
    out_of = held_out(id_col)
    model = learn(docs.where(~out_of & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()), path, id_col, text_col, label_col)
    found = predict(docs, model, path, id_col, text_col)
    return found.select(id_col, out_of.alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of docs that language_id() gives a language: those with a text that has a letter
    in it. The texts ride along through the model, so there is no join."""
    ship(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    model = learn(labelled, path, id_col, text_col, label_col)
    score = _predict(path, *model)
    at = docs.columns.index(text_col)

    def run(batches):
        # One pass of the model over all batches, whose rows it gives in their order.
        waiting = deque()

        def texts():
            for batch in batches:
                if len(batch):
                    waiting.append(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(batch)), pa.int64()), batch.column(at)], names=["id", "text"])

        keep = []
        for b in score(texts()):
            keep += [x != "und" for x in b.column(1).to_pylist()]
            while waiting and len(keep) >= len(waiting[0]):
                batch = waiting.popleft()
                yield batch.filter(pa.array(keep[: len(batch)]))
                del keep[: len(batch)]

    return docs.mapInArrow(run, docs.schema)
