"""Document languages by prediction by partial matching: per-language trees of byte contexts, exact code lengths.

A language's tree counts which byte follows each context of up to ``ORDER`` bytes within a word. Its statistics are frozen
after training, so the code length of a word (escape method C: an unseen byte pays for the escape and is predicted by the
next shorter context) is a fixed number for each language and is computed once for each distinct word of a worker. A
sentence's code lengths are the sums of its words'; the shortest wins, by a margin that gives the confidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.textform import consistent

# Codes and names of the languages, as labels write them.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "zh": "zh zho chi chinese 中文 汉语",
    "ru": "ru rus russian русский",
}
LANGS = tuple(NAMES)
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
#: Context bytes; labelled documents to train on at most; least words of a sentence that is judged; least margin in bits.
ORDER, SAMPLE, LEAST_WORDS, LEAST_BITS = 4, 1_500, 3, 10.0
#: Contexts that were seen less often are left out of the trees, so that names don't fill them.
LEAST_SEEN = 3
ROWS = 500
#: Parts that hold no language: runs with digits, paths, addresses, code.
_TECHNICAL = re.compile(r"[A-Za-z0-9.@/\\:+%#=<>|*~^$_-]*[0-9@/\\_=<>|][A-Za-z0-9.@/\\:+%#=<>|*~^$_-]*")
_WORDS = re.compile(r"[㐀-鿿]{1,4}|[^\W\d_㐀-鿿]+")
_ENDS = re.compile(r"(?<=[.!?…])[\"”’')\]]*\s+|(?<=[。！？])|[\r\n\v\f\x85  ]+")
_ROLE = re.compile(r"^\s*(?:[-*•>]\s+|\d+[.)]\s+)*(?:(?:user|assistant|system|tool|human|ai)\s*:\s*)?", re.I)
_META = re.compile(r"^\s*(?:#+\s|---|[A-Za-z_-]{2,20}:\s*(?:\[.*\]|[!-~]*[^\s.!?])\s*$)")


def label_of(label: str | None) -> str | None:
    """The language a label names, in whatever notation; None if it names none of the known ones."""
    if label is None:
        return None
    t = label.strip().lower()
    return _BY_NAME.get(t) or _BY_NAME.get(re.split(r"[-_]", t)[0])


def sentences(text: str | None, whole: bool = True) -> list[str]:
    """Whole sentences of a text, without front matter, headings, role names and bullets; without ``whole`` also what no
    closing mark ends. The marks of full width stay as they are for the cut."""
    if not text:
        return []
    body = text
    if body.lstrip().startswith("---"):
        head = re.match(r"\s*---[^\n]*\n(?:[^\n]*\n)*?---[^\n]*(?:\n|$)", body)
        body = body[head.end() :] if head else body
    out = []
    for line in re.split(r"[\r\n\v\f\x85  ]+", body):
        line = _ROLE.sub("", line, count=1)
        if _META.match(line):
            continue
        for s in _ENDS.split(line):
            s = s.strip().strip("“”\"")
            if s and (not whole or s[-1] in ".!?…。！？"):
                out.append(s)
    return out


def words(sentence: str) -> list[str]:
    return _WORDS.findall(_TECHNICAL.sub(" ", consistent(sentence)).lower())


class Trees:
    """Frozen code lengths: a row of bits, one for each language, for each context with a byte, and for each escape."""

    def __init__(self, counts: list[dict[bytes, Counter]]):
        size = len(counts)
        kept: list[dict[bytes, tuple[dict[int, float], float]]] = []
        for tree in counts:
            own = {}
            for context, follow in tree.items():
                n, d = sum(follow.values()), len(follow)
                if n >= LEAST_SEEN or not context:
                    own[context] = {s: -math.log2(c / (n + d)) for s, c in follow.items()}, -math.log2(d / (n + d))
            kept.append(own)
        contexts = sorted({c for own in kept for c in own}, key=len)
        self.bits: dict[bytes, np.ndarray] = {}
        self.escape: dict[bytes, np.ndarray] = {}
        flat = np.full(size, 8.0, np.float32)
        for context in contexts:
            nodes = [own.get(context) for own in kept]
            self.escape[context] = escape = np.array([n[1] if n else 0.0 for n in nodes], np.float32)
            for s in {s for n in nodes if n for s in n[0]}:
                shorter = self._below(context, s, flat)
                row = np.array([n[0].get(s, -1.0) if n else -1.0 for n in nodes], np.float32)
                self.bits[context + bytes((s,))] = np.where(row >= 0, row, escape + shorter)

    def _below(self, context: bytes, s: int, flat: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flat), np.float32)
        while context:
            context = context[1:]
            row = self.bits.get(context + bytes((s,)))
            if row is not None:
                return total + row
            total = total + self.escape.get(context, 0)
        return total + flat

    def length(self, word: str) -> np.ndarray:
        """Code length of a word in each language, in bits; a word begins and ends with a blank."""
        data = b" " + word.encode("utf-8", "surrogatepass") + b" "
        total = 0.0
        for i in range(1, len(data)):
            context = data[max(0, i - ORDER) : i]
            while (row := self.bits.get(context + data[i : i + 1])) is None:
                total = total + self.escape.get(context, 0)
                if not context:
                    row = 8.0
                    break
                context = context[1:]
            total = total + row
        return np.asarray(total, np.float32)


def grow(samples: Iterable[tuple[int, Counter]], languages: int) -> Trees:
    """Trees from word counts of each language."""
    seen: list[Counter] = [Counter() for _ in range(languages)]
    for k, ws in samples:
        seen[k].update(ws)
    counts: list[dict[bytes, Counter]] = []
    for c in seen:
        tree: dict[bytes, Counter] = defaultdict(Counter)
        for w, n in c.items():
            data = b" " + w.encode("utf-8", "surrogatepass") + b" "
            for i in range(1, len(data)):
                for k in range(min(i, ORDER) + 1):
                    tree[data[i - k : i]][data[i]] += n
        counts.append(tree)
    return Trees(counts)


class Judge:
    """Sentences' languages by frozen trees, with the words met so far."""

    def __init__(self, trees: Trees):
        self.trees, self.known, self.rows = trees, {}, np.empty((1 << 12, len(LANGS)), np.float32)

    def _row(self, w: str) -> int:
        known = self.known
        if len(known) >= 1 << 20:
            known.clear()
        at = known[w] = len(known)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[at] = self.trees.length(w)
        return at

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, margin in bits) of each sentence, given by its words; -1 where it isn't judged."""
        lang, margin = np.full(len(texts), -1), np.zeros(len(texts), np.float32)
        sizes = np.array([len(t) for t in texts], np.int64)
        use = np.flatnonzero(sizes >= LEAST_WORDS)
        if not len(use):
            return lang, margin
        get = self.known.get
        parts = []
        for i in use:
            ids = [r if (r := get(w)) is not None else self._row(w) for w in texts[i]]
            parts.append(self.rows[ids].sum(axis=0) if len(self.known) < 1 << 20 else np.sum([self.trees.length(w) for w in texts[i]], axis=0))
        total = np.array(parts)
        order = np.argsort(total, axis=1)[:, :2]
        best = np.take_along_axis(total, order, 1)
        lang[use], margin[use] = order[:, 0], best[:, 1] - best[:, 0]
        return lang, margin


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Trees:
    """Trees from at most ``SAMPLE`` documents with a label of a known language, those with the least hash of their id.
    Trained twice: the second time on the sentences that the first trees give the language of their document's label."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, label_col)
    known = F.lower(F.regexp_extract(F.trim(label_col), r"^([^-_]+)", 1)).isin(*_BY_NAME)
    share = min(1.0, 4 * SAMPLE / max(1, rows.count()))  # so that no more than a few samples' worth is sorted
    low = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = rows.where(known & low).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).collect()
    parts = []
    for _, text, label in sample:
        k = LANGS.index(label_of(label)) if label_of(label) else None
        if k is not None:
            parts += [(k, w) for s in sentences(text) if len(w := words(s)) >= LEAST_WORDS]
    first = Judge(grow(((k, Counter(w)) for k, w in parts), len(LANGS)))
    lang, margin = first([w for _, w in parts])
    return grow(((k, Counter(w)) for (k, w), g, m in zip(parts, lang, margin) if g == k and m >= LEAST_BITS), len(LANGS))


def judged(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", open_too: bool = False) -> DataFrame:
    """(id column, label, part, lang, sentences, bits, words): the segments of each document: runs of sentences of one
    language, numbered from 0; ``label`` is the language that the document's label names, null if none. With ``open_too``
    documents without a whole sentence give segments of their unclosed lines, with 0 sentences."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(trees)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                closed = [sentences(t) for t in piece.column(1).to_pylist()]
                texts = [[words(s) for s in (c or (sentences(t, False) if open_too else ()))] for c, t in zip(closed, piece.column(1).to_pylist())]
                lang, margin = judge([w for t in texts for w in t])
                out: list[list] = [[] for _ in range(6)]
                labels = [label_of(x) for x in piece.column(2).to_pylist()]
                k = 0
                for d, t in enumerate(texts):
                    part, last = -1, -1
                    for w in t:
                        g, m = int(lang[k]), float(margin[k])
                        k += 1
                        if g < 0 or m < LEAST_BITS:
                            continue
                        if g != last:
                            part, last = part + 1, g
                            for column, v in zip(out, (d, part, LANGS[g], 0, 0.0, 0)):
                                column.append(v)
                        out[3][-1] += bool(closed[d])
                        out[4][-1] += m
                        out[5][-1] += len(w)
                ids = piece.column(0).take(pa.array(out[0], pa.int64()))
                names = pa.array([labels[d] for d in out[0]], pa.string())
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.int32())], ["id", "label", "part", "lang", "sentences", "bits", "words"])

    return docs.select(id_col, text_col, label_col).mapInArrow(run, f"id {kind}, label string, part int, lang string, sentences int, bits double, words int").withColumnRenamed("id", id_col)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id column, part, lang, sentences, confidence): each document's segments with their languages.

    The confidence is 1 - 2**(-bits for each word by which the second language codes the segment longer), half of that for
    text without a single closed sentence. Null and blank documents and those whose lines hold no language (tool logs) have no
    segment; repeated rows come out repeated.
    """
    s = judged(docs, train(docs, id_col, text_col, label_col), id_col, text_col, label_col, open_too=True)
    sure = (1 - F.pow(F.lit(2.0), -F.col("bits") / F.col("words"))) * F.when(F.col("sentences") > 0, 1.0).otherwise(0.5)
    return s.select(id_col, "part", "lang", "sentences", F.round(sure, 4).alias("confidence"))


def document_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id column, label, lang, sentences, confidence): one row for each language of each document."""
    s = judged(docs, train(docs, id_col, text_col, label_col), id_col, text_col, label_col)
    by = s.groupBy(id_col, "label", "lang").agg(F.sum("sentences").alias("sentences"), (1 - F.pow(F.lit(2.0), -F.sum("bits") / F.sum("words"))).alias("confidence"))
    return by.withColumn("confidence", F.round("confidence", 4))


def mislabelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id column, lang): each language of the documents whose label is missing, names no language or another one than the
    document's, and of the documents in several languages."""
    s = judged(docs, train(docs, id_col, text_col, label_col), id_col, text_col, label_col)
    by = s.groupBy(id_col).agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return by.where(wrong).select(id_col, F.explode("langs").alias("lang"))
