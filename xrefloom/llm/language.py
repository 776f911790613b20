"""Language ID by multilingual mixture inference.

Training counts byte trigrams of words (with word ends marked) by language over all training rows; a trigram is hashed to
one of 2**bits cells, so the model is a table of bounded size. A document is taken as a mixture: every word comes from
one language of a set, and expectation-maximisation over the words estimates the languages' proportions from their
trigram likelihoods. Sets of 1, 2, ... languages, nested by the proportions of the full mixture, are compared by
penalised likelihood (BIC: half the logarithm of the word count for each language more), all of them for every document
whose words leave the question open, so that no result hangs on a document's neighbours; and the best set's largest
proportion names the document's language.

Tables of up to `resident` languages are broadcast. Those of more languages lie in the shared folder, one file for each
`resident` of them; tasks read one file at a time, and the results are the same.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from ..sources.files import located
from .common import saved, scratch_dir, slices, whole_text, with_fields

_BLOCKS = 64
#: A task that counts holds so many languages' tables at most (256 KB each), and then passes them on.
_HELD = 256
#: Words times languages whose likelihoods are in memory at once.
_CELLS = 1 << 24


def trigrams(col: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all trigrams of all words, each word's offset into them, and the words' documents.

    Letters A-Z count as lower case; each word (anything between ASCII spaces, punctuation or digits) is read with a
    blank before and after it, so a word of k bytes has k trigrams.
    """
    buf, off = tv.text_bytes(col)
    code = _FOLDED[buf]
    letter = code != 32
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | first[1:-1]
    at = np.flatnonzero(letter)
    before = np.where(begins[at], 32, code[at - 1]).astype(np.uint32)
    after = np.where(ends[at], 32, code[np.minimum(at + 1, len(buf) - 1)]).astype(np.uint32) if len(at) else before
    cell = ((before << np.uint32(16) | code[at].astype(np.uint32) << np.uint32(8) | after) * np.uint32(2654435769)) >> np.uint32(32 - bits)
    start = np.flatnonzero(begins)
    return cell.astype(np.int64), np.searchsorted(at, start), np.searchsorted(off, start, "right") - 1


_FOLDED = np.where(tv.ALNUM & ~((np.arange(256) >= 48) & (np.arange(256) < 58)), np.arange(256), 32).astype(np.uint8)
_FOLDED[65:91] = np.arange(97, 123)


def _counter(bits: int):
    def count(batches):
        tables: dict[str, np.ndarray] = {}
        size = (1 << bits) // _BLOCKS

        def passed_on():
            for name, t in tables.items():
                yield pa.RecordBatch.from_pydict({"lang": [name] * _BLOCKS, "block": pa.array(range(_BLOCKS), pa.int32()), "counts": pa.array(list(t.reshape(_BLOCKS, size)), pa.list_(pa.int64()))})
            tables.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                if len(tables) > _HELD:
                    yield from passed_on()
                cells, start, docs = trigrams(part.column("text"), bits)
                lang = part.column("lang").dictionary_encode()
                if not len(start):
                    continue
                words = lang.indices.to_numpy()[docs]
                which = np.repeat(words, np.diff(np.append(start, len(cells))))
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    tables.setdefault(name, np.zeros(1 << bits, np.int64))
                    tables[name] += np.bincount(cells[which == k], minlength=1 << bits)
        yield from passed_on()

    return count


def _adder(batches):
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for lang, block, counts in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            c = counts.values.to_numpy()
            total[lang, block] = total[lang, block] + c if (lang, block) in total else c
    if total:
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "block": pa.array([k[1] for k in total], pa.int32()), "counts": pa.array(list(total.values()), pa.list_(pa.int64()))})


def _log_probabilities(langs: list[str], bits: int, counts: Iterable[tuple[str, int, np.ndarray]]) -> np.ndarray:
    table, row, size = np.zeros((len(langs), 1 << bits)), {name: k for k, name in enumerate(langs)}, (1 << bits) // _BLOCKS
    for lang, block, c in counts:
        table[row[lang], block * size : (block + 1) * size] = c
    return np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * (1 << bits))).astype(np.float32)


def _columns(t: pa.Table) -> Iterator[tuple[str, int, np.ndarray]]:
    return zip(t["lang"].to_pylist(), t["block"].to_pylist(), t["counts"].to_pylist(), strict=True)


def _file_writer(folder: str, bits: int):
    def write(group: pa.Table) -> pa.Table:
        langs = sorted(set(group["lang"].to_pylist()))
        system, path = located(folder)
        system.create_dir(path, recursive=True)
        name, data = f"{uuid.uuid4().hex}.npy", io.BytesIO()
        np.save(data, _log_probabilities(langs, bits, _columns(group)))
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(data.getvalue())
        return pa.table({"part": group["part"][:1], "file": [f"{folder}/{name}"]})

    return write


def fit(labelled: DataFrame, bits: int = 15, resident: int = 64) -> dict:
    """Count trigrams by language over all rows of columns text and lang; rows with a null lang are left out.

    Returns {langs, bits} and the log probabilities, languages by cells: `logp`, or, for more than `resident` languages,
    `files` with `resident` languages each in the shared folder. The driver then holds names of languages and files only.
    """
    spark = labelled.sparkSession
    rows = labelled.select(whole_text("text"), F.col("lang").cast("string")).filter("lang is not null")
    parts = rows.mapInArrow(_counter(bits), "lang string, block int, counts array<long>")
    counts = saved(parts.repartition("lang", "block").mapInArrow(_adder, "lang string, block int, counts array<long>"))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = {"langs": langs, "bits": bits}
    if len(langs) <= resident:
        return model | {"logp": _log_probabilities(langs, bits, _columns(counts.toArrow()))}
    part = spark.createDataFrame([(name, k // resident) for k, name in enumerate(langs)], "lang string, part int")
    folder = f"{scratch_dir(spark)}/languages-{uuid.uuid4().hex}"
    files = counts.join(part, "lang").groupBy("part").applyInArrow(_file_writer(folder, bits), "part int, file string").collect()
    return model | {"files": [f.file for f in sorted(files)]}


def _tables(model: dict) -> Iterator[np.ndarray]:
    """The model's log probabilities, languages by cells, one part after the other."""
    if "logp" in model:
        yield model["logp"]
    for file in model.get("files", ()):
        system, path = located(file)
        with system.open_input_file(path) as f:
            yield np.load(io.BytesIO(f.read()))


def _word_scores(model: dict, cells: np.ndarray, start: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Log likelihoods, words by languages, for each part of the model and each stretch of words: (first language, first word, values)."""
    first, bounds = 0, np.append(start, len(cells))
    for table in _tables(model):
        step = max(1, most // len(table))
        for a in range(0, len(start), step):
            b = min(len(start), a + step)
            own = cells[bounds[a] : bounds[b]]
            yield first, a, np.stack([np.add.reduceat(row[own], start[a:b] - start[a]) for row in table], 1).astype(np.float64)
        first += len(table)


def _likelihoods(model: dict, cells: np.ndarray, start: np.ndarray, top: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The likelihoods of some words in all languages, over those in their best language."""
    size = np.diff(np.append(start, len(cells)))[words]
    begin = np.cumsum(size) - size
    own = cells[np.repeat(start[words] - begin, size) + np.arange(size.sum())]
    like = np.empty((len(words), len(model["langs"])), np.float32)
    for first, a, ll in _word_scores(model, own, begin, _CELLS):
        like[a : a + len(ll), first : first + ll.shape[1]] = np.exp(np.maximum(ll - top[words[a : a + len(ll)], None], -60.0))
    return like


class _Lazy:
    """Likelihoods of so many words that they are computed anew for each stretch of `step` words, whenever they are asked for."""

    def __init__(self, step: int, compute: Callable[[slice], np.ndarray]):
        self.step, self.compute = step, compute

    def __getitem__(self, stretch: slice) -> np.ndarray:
        return self.compute(stretch)


def _mixture(like: np.ndarray | _Lazy, best: np.ndarray, docs: np.ndarray, n: int, mask: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions (n by languages) inside each document's set, and log likelihoods.

    like: each word's likelihoods over its best language's; best: the sum of those logarithms by document.
    """
    words = np.bincount(docs, minlength=n)
    step = like.step if isinstance(like, _Lazy) else max(1, len(docs))
    stretches = [slice(a, a + step) for a in range(0, len(docs), step)]
    pi = mask / mask.sum(1, keepdims=True)
    for _ in range(rounds):
        total = np.zeros_like(pi)
        for s in stretches:
            part = like[s] * pi[docs[s]]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            total += tv.per_doc_sum(part, np.searchsorted(docs[s], np.arange(n + 1)))
        pi = total / np.maximum(words, 1)[:, None]
    seen = np.zeros(n)
    for s in stretches:
        seen += np.bincount(docs[s], np.log(np.maximum((like[s] * pi[docs[s]]).sum(1), 1e-30)), n)
    return pi, seen + best


def _groups(words: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of documents with about `most` words together, one document at least."""
    ends, a = np.cumsum(words), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def infer(col: pa.Array, model: dict, rounds: int = 5, most: int = _CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text: its main language's number, that language's proportion, and how many languages its set has.

    At most about `most` likelihoods (words times languages) are held; those of a longer text are computed piece by piece.
    """
    n, count = len(col), len(model["langs"])
    lang, share, size = np.zeros(n, np.int64), np.zeros(n), np.ones(n, np.int64)
    cells, start, docs = trigrams(col, model["bits"])
    if not len(start) or not count:
        return lang, share, size
    single, top = np.zeros((n, count)), np.full(len(start), -np.inf)
    limit = max(1, most // count)
    for first, a, ll in _word_scores(model, cells, start, most):
        b = a + len(ll)
        top[a:b] = np.maximum(top[a:b], ll.max(1))
        for k in range(ll.shape[1]):
            single[:, first + k] += np.bincount(docs[a:b], ll[:, k], n)
    words = np.bincount(docs, minlength=n)
    best = np.bincount(docs, top, n)
    lang = single.argmax(1)
    share = np.where(words > 0, 1.0, 0.0)
    penalty = 0.5 * np.log(np.maximum(words, 1))
    score = single.max(1) - penalty
    # no set can gain more than reading every word in its best language: elsewhere one language is the answer
    at = np.flatnonzero((words > 0) & (best - 2 * penalty > score))
    offset = np.searchsorted(docs, np.arange(n + 1))
    for a, b in _groups(words[at], limit):
        some = at[a:b]
        own = np.concatenate([np.arange(offset[d], offset[d + 1]) for d in some])
        row = np.repeat(np.arange(len(some)), words[some])
        like = _likelihoods(model, cells, start, top, own) if len(own) <= limit else _Lazy(limit, lambda s, own=own: _likelihoods(model, cells, start, top, own[s]))
        full, _ = _mixture(like, best[some], row, len(some), np.ones((len(some), count)), rounds)
        rank = np.argsort(np.argsort(-full, 1, kind="stable"), 1)
        for k in range(2, count + 1):
            # the same bound: no larger set can win any more (a hair is left for rounding)
            if not (best[some] - k * penalty[some] > score[some] - 1e-6 * words[some]).any():
                break
            pi, seen = _mixture(like, best[some], row, len(some), (rank < k).astype(float), rounds)
            won = seen - k * penalty[some] > score[some]
            w = some[won]
            score[w], lang[w], share[w], size[w] = (seen - k * penalty[some])[won], pi[won].argmax(1), pi[won].max(1), k
    return lang, share, size


def _predictor(model, passed: list[str]):
    def predict(batches):
        m = model.value
        names = pa.array([*m["langs"], "und"])
        for batch in batches:
            for part in slices(batch, "text"):
                lang, share, size = infer(part.column("text"), m)
                lettered = part.column("lettered").to_numpy(zero_copy_only=False) & bool(m["langs"])
                cols = [part.column(c) for c in passed]
                cols += [names.take(pa.array(np.where(lettered, lang, len(names) - 1))), pa.array(np.where(lettered, share, 0.0)), pa.array(np.where(lettered, size, 0), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, [*passed, "lang_pred", "score", "n_langs"])

    return predict


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred, score (its proportion) and n_langs (size of the chosen set) for every row.

    A text that is null or has no letter of any script gets `und`, 0 and 0, and so does every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, whole_text(text)).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    passed = [f for f in rows.schema if f.name not in ("text", "lettered")]
    return rows.mapInArrow(_predictor(shared, [f.name for f in passed]), with_fields(passed, "lang_pred string, score double, n_langs int"))
