"""Sentence boundaries by a hidden-event n-gram language model.

Between any two words a text may hide an event, the sentence boundary. Candidates are the gaps behind end marks (with
their closing quotes and brackets), blanks between Thai letters, and, in paragraphs that have neither, every blank. A
blank line always is a boundary. The model holds exact counts over all documents:

* how often words begin a paragraph (an event seen for certain) against how often they follow a candidate gap, as
  n-grams (word, next word) that back off to the word and to its class: the probability of an event before these words;
* how often gaps after a word are events, which follows from the words behind them (one step of EM); for words without
  a mark, how often they end a paragraph;

and forward-backward over the gaps of a paragraph combines both with priors on classes and on one-word sentences into
posteriors. Nothing is learned from labels.

The texts are read once, into a table of gaps with hashed keys; everything after that is aggregates and joins of that
table, so the model's size follows the corpus and no part of it has to fit anywhere. Frequent words meet their counts
through the table of distinct n-grams.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.streams import whole_groups
from tidemark.session import stored

MARKS = ".!?…。！？｡।؟۔"
#: Marks that need no blank behind them.
WIDE = "。！？｡"
CLOSERS = "\"'”’»」』)）]］】》〉›"
OPENERS = "\"'“‘„«「『(（[［【《〈‹¿¡—–-"
_BLANK_LINE = re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\r[^\S\r\n]*\r\s*| \s*")
_WORD = re.compile(r"\S+")
_WIDE_END = re.compile(f"[{WIDE}]+[{re.escape(CLOSERS)}]*")
_OPEN_GAP = re.compile(f"([{re.escape(MARKS)}]+)([{re.escape(CLOSERS)}\\s]*)$")
_ATTACHES = re.compile(r"[?!»”’)\]」』）؟]+")
#: What needs a closer look: wide marks, closing marks behind a blank, opening ones before a blank.
_SPECIAL = re.compile(f"[{WIDE}]|[?!»”’)\\]」』）؟](?<=\\s.)|[“„«「『(（[［【《〈‹¿¡‘—–-](?!\\S)", re.DOTALL)
#: A mark inside a word, with its closing quotes and brackets.
_JOINT = re.compile(f"([.!?…।؟]+)([{re.escape(CLOSERS)}]*)(?=[{re.escape(OPENERS)}]*[^\\W_]|[\U0001F000-\U0001FAFF])")
_LAST = frozenset(MARKS + CLOSERS)
_THAI = re.compile(r"[ก-๎]")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_YEAR = re.compile(r"(?:19|20)\d\d")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿가-힯]")
_BRACKET = re.compile(r"[()（）]")
_VOWEL = re.compile(r"[aeiouyáéíóúäöüàèâêîôûëïаеёиоуыэюя]")

#: Strength of the class behind an n-gram, in counts.
BACK_OFF = 2.0
#: No single n-gram weighs more than this, in log odds.
WEIGHT = 4.0
#: Prior log odds; two n-grams against them outvote all but that of Thai, whose blank is an event by definition.
PRIOR_WORD_CAPITAL = 2.0
PRIOR_IN_BRACKETS = -3.0
PRIOR_ONE_WORD = -2.0
PRIOR_NO_MARK = -6.0
PRIOR_THAI = 12.0
#: A capitalised word is of its own class if it is written small in the middle of sentences, and hardly ever large there.
RARELY_LARGE = 0.01


def mask(word: str) -> str:
    return _NUMBER.sub(lambda m: "Y" if _YEAR.fullmatch(m.group()) else "#", word)


class Gap:
    """A candidate: the word before it with its mark, and the two words behind it."""

    __slots__ = ("at", "left", "left_class", "right", "right_class", "pair", "word", "words", "inside", "strong")


@lru_cache(maxsize=100_000)
def _left(word: str) -> tuple[str, str, bool]:
    """Key and class of a word before an open gap, and whether its mark alone says end."""
    m = _OPEN_GAP.search(word)
    marks, closed = m[1], re.sub(r"\s", "", m[2])
    body = mask(word[: m.start()].lstrip(OPENERS).rstrip())
    strong = any(c in "!?。！？｡।؟۔" for c in marks)
    if strong:
        kind = "strong" + ("q" if closed else "")
    elif len(marks) > 1 or "…" in marks:
        kind = "dots"
    elif not body:
        kind = "bare"
    elif body[-1] in "#Y%":
        kind = "number"
    elif "." in body:
        kind = "inner"
    elif len(body) == 1:
        kind = "initial"
    elif body.isalpha() and body == body.lower() and body != body.upper() and len(body) >= 4 and _VOWEL.search(body):
        kind = "word"
    elif len(body) <= 4:
        kind = "short"
    else:
        kind = "long"
    if _CJK.search(body):
        body = "~"  # scripts without blanks: what stands before the mark is no word
    return f"{body}{marks}{closed}", kind + ("c" if closed else ""), strong


@lru_cache(maxsize=100_000)
def _right(word: str, after: str) -> tuple[str, str, str, str]:
    """Key, class, key with the word behind it, and the bare word of what follows an open gap."""
    bare = word.lstrip(OPENERS)
    front = word[: len(word) - len(bare)]
    body = bare.rstrip(MARKS + CLOSERS + ",;:，、；：؛")
    first = bare[:1]
    if _CJK.match(first):
        return front + bare[:2], "cjk" + ("o" if front else ""), front + bare[:4], bare[:2]
    if first.isdigit():
        kind = "digit"
    elif first.isupper():
        kind = "Upper" if len(body) > 1 and body.isupper() else "Capital"
    elif first.islower():
        kind = "small"
    elif first.isalpha():
        kind = "letter"
    else:
        kind = "sign"
    key = front + mask(body)
    return key, kind + ("o" if front else ""), f"{key} {mask(after)}", body


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text between blank lines, without blanks at their ends; none for blank text."""
    begin = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[begin:stop]
        kept = part.strip()
        if kept:
            lead = len(part) - len(part.lstrip())
            yield begin + lead, begin + lead + len(kept)
        if m:
            begin = m.end()


def joints(text: str, begin: int, stop: int) -> list[int]:
    """Places inside the words of a paragraph where a sentence may end without a blank (``the call.The plan``).

    A single full stop may be one between a word of two letters, a number or a bracket and a capital, or a letter of a
    script without case, and between a word of three letters and a small letter or a digit. The model decides.
    """
    out = []
    for m in _JOINT.finditer(text, begin, stop):
        i = m.start()
        if i == begin or text[i - 1].isspace():
            continue
        end = m.end()
        if m[1] == ".":
            tail = text[i - 1]
            k = end
            while text[k] in OPENERS:
                k += 1
            a = text[k]
            if a.isdigit():
                if not (tail in "%)]" or text[max(begin, i - 3) : i].isalpha() and i - begin >= 3):
                    continue
            elif a.islower():
                if not (text[max(begin, i - 3) : i].isalpha() and i - begin >= 3):
                    continue
            elif a.isupper():
                two = text[max(begin, i - 2) : i]
                if not (len(two) == 2 and two.isalpha() and not two.isupper() or tail.isdigit() or tail in "%)]" or text[k + 1 : k + 2].islower()):
                    continue
            elif not text[max(begin, i - 2) : i].isalpha() or i - begin < 2:
                continue
        if m[2].endswith('"') and text.count('"', begin, end - 1) % 2 == 0:
            end -= 1  # an even number of straight quotes before it: this one opens
        out.append(end)
    return out


def words(text: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """Words of a paragraph: split at blanks, behind wide end marks and other marks that may end a sentence without a
    blank, and with detached marks and quotes attached."""
    inner = joints(text, begin, stop)
    if not _SPECIAL.search(text, begin, stop):
        plain = [m.span() for m in _WORD.finditer(text, begin, stop)]
        for c in inner:
            k = bisect_right(plain, (c, 0)) - 1
            x, y = plain[k]
            if x < c < y and "://" not in text[x:y]:
                plain[k : k + 1] = [(x, c), (c, y)]
        return plain
    out: list[tuple[int, int]] = []
    opening = None
    for m in _WORD.finditer(text, begin, stop):
        s, e = m.span()
        token = m.group()
        if out and opening is None and _ATTACHES.fullmatch(token):
            out[-1] = (out[-1][0], e)
            continue
        if all(c in OPENERS for c in token) and token not in ("-", "–", "—", '"', "'") and e < stop:
            opening = s if opening is None else opening
            continue
        first = s if opening is None else opening
        opening = None
        cuts = {s + w.end() for w in _WIDE_END.finditer(token)} if any(c in token for c in WIDE) else set()
        if inner and "://" not in token:
            cuts.update(inner[bisect_left(inner, s) : bisect_left(inner, e)])
        for c in sorted(cuts):
            if first < c < e:
                out.append((first, c))
                first = c
        out.append((first, e))
    if opening is not None:
        out.append((opening, stop))
    return out


def bare_word(word: str) -> str:
    return word.strip(OPENERS + CLOSERS + ",;:.")


def _small(word: Column) -> Column:
    """How a word is written small; none for single letters, whose case says little."""
    return F.when(F.length(word) > 1, F.lower(word))


def open_gaps(text: str, span: list[tuple[int, int]]) -> list[Gap]:
    """The candidates between the words of a paragraph."""
    gaps, depth, since = [], 0, 0
    last = len(span) - 1
    bracketed = bool(span) and _BRACKET.search(text, span[0][0], span[-1][1]) is not None
    for i, (s, e) in enumerate(span):
        since += 1
        if bracketed:
            word = text[s:e]
            depth = max(0, depth + word.count("(") + word.count("（") - word.count(")") - word.count("）"))
        if i == last:
            break
        mark = text[e - 1] in _LAST and _OPEN_GAP.search(text[s:e])
        if mark or (_THAI.match(text[e - 1]) and _THAI.match(text[span[i + 1][0]])):
            g = _gap(text, span, i)
            if since == 1 and _CJK.search(text, s, e):
                since = max(1, (e - s) // 2)  # scripts without blanks
            g.words, g.inside = since, depth > 0
            g.left, g.left_class, g.strong = _left(text[s:e]) if mark else (text[max(s, e - 4) : e], "thai", False)
            gaps.append(g)
            since = 0
    if not gaps and last > 0:
        for i in range(last):  # no mark anywhere: an event may hide in every gap
            g = _gap(text, span, i)
            g.left, g.left_class, g.strong, g.words, g.inside = bare_word(text[span[i][0] : span[i][1]]), "none", False, 2, False
            g.pair = g.right = g.word
            gaps.append(g)
    return gaps


def _gap(text: str, span: list[tuple[int, int]], i: int) -> Gap:
    g = Gap()
    g.at = i
    after = text[span[i + 2][0] : span[i + 2][1]] if i + 2 < len(span) else ""
    g.right, g.right_class, g.pair, g.word = _right(text[span[i + 1][0] : span[i + 1][1]], after)
    return g


#: Kinds of rows: a candidate, the start of a paragraph (with its first words and last word), counts of words.
GAP, START, WORD = 0, 1, 2
_TEXT_KEYS = ["left", "right", "pair", "word"]
_ROW = "kind byte, rid long, doc_id long, para int, idx int, e int, s int, left string, lc string, right string, rc string, pair string, word string, words int, inside boolean, strong boolean, n long"
_ARROW = pa.schema([(c.split()[0], {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in _ROW.split(", ")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROW for each document: a START per paragraph, its GAPs in order, and WORDs per batch."""
    rid = TaskContext.get().partitionId() << 33  # names a row of the input, also where doc_id repeats
    for b in batches:
        rows: list[tuple] = []
        plain: Counter = Counter()
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            rid += 1
            for para, (begin, stop) in enumerate(paragraphs(text or "")):
                span = words(text, begin, stop)
                gaps = open_gaps(text, span)
                after = text[span[1][0] : span[1][1]] if len(span) > 1 else ""
                right, rc, pair, word = _right(text[span[0][0] : span[0][1]], after)
                end = text[span[-1][0] : span[-1][1]]
                marked = _OPEN_GAP.search(end) is not None
                rows.append((START, rid, doc, para, -1, stop, begin, None if marked else bare_word(end), None, right, rc, pair, word, 0, False, marked and _left(end)[2], 1))
                behind = {0}
                for k, g in enumerate(gaps):
                    rows.append((GAP, rid, doc, para, k, span[g.at][1], span[g.at + 1][0], g.left, g.left_class, g.right, g.right_class, g.pair, g.word, g.words, g.inside, g.strong, 1))
                    if g.left_class != "none":
                        behind.add(g.at + 1)
                plain.update([text[x:y] for i, (x, y) in enumerate(span) if i not in behind])
        total: Counter = Counter()
        for w, n in plain.items():
            bare = bare_word(w)
            if bare.isalpha():
                total[bare] += n
        rows += [(WORD, 0, None, 0, 0, 0, 0, None, None, None, None, None, w, 0, False, False, n) for w, n in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def gap_table(documents: DataFrame) -> DataFrame:
    """What the model needs of the texts, as a written table; words and n-grams are 64-bit hashes in it."""
    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(_read, _ROW)
    hashed = rows.withColumn("low", _small(F.col("word"))).withColumns({c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in [*_TEXT_KEYS, "low"]})
    return stored(hashed, "gaps", ["kind"])  # most readers need one kind


@dataclass(frozen=True)
class Model:
    """Counts of a corpus: words in the middle of sentences, first words, n-grams, and the words before candidates.

    scale: candidates that are events per event seen for certain; before, after: classes with (events, candidates).
    """

    scale: float
    middle: DataFrame
    rights: DataFrame
    pairs: DataFrame
    lefts: DataFrame
    before: dict[str, tuple[float, float]]
    after: dict[str, tuple[float, float]]


def _keys(rows: DataFrame) -> DataFrame:
    """Distinct words behind candidates and at starts, with counts of both; those without a mark (none) only ask."""
    ask = rows.filter(F.col("kind") != WORD).withColumn("none", F.coalesce(F.col("lc") == "none", F.lit(False)))
    start, gap = F.sum(F.when(F.col("kind") == START, 1).otherwise(0)), F.sum(F.when((F.col("kind") == GAP) & ~F.col("none"), 1).otherwise(0))
    return ask.groupBy("none", "pair", "right", "word", "low", "rc").agg(start.alias("s"), gap.alias("a"))


def _classed(keys: DataFrame, middle: DataFrame, rights: DataFrame) -> DataFrame:
    """keys with the counts of their words and with the class of capitals that are written small elsewhere."""
    k = keys.join(rights.withColumnsRenamed({"s": "s1", "a": "a1"}), "right", "left")
    k = k.join(middle.withColumnsRenamed({"n": "large"}), "word", "left").join(middle.withColumnsRenamed({"word": "low", "n": "small"}), "low", "left")
    k = k.fillna(0, ["s1", "a1", "large", "small"])
    lowered = F.col("rc").startswith("Capital") & (F.col("small") > 0) & (F.col("word") != F.col("low")) & (F.col("large") <= RARELY_LARGE * (F.col("small") + F.col("a1")))
    return k.withColumn("rc", F.when(lowered, F.concat("rc", F.lit("+"))).otherwise(F.col("rc")))


def _of(classes: dict[str, tuple[float, float]], key: Column, at: int) -> Column:
    """A number of a class: some tens of literals."""
    if not classes:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in sorted(classes.items()) for x in (k, float(v[at]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def _before(keys: DataFrame, m: Model) -> DataFrame:
    """(none, pair, word, rc, p): the probability of an event before the words of each key."""
    k = _classed(keys.drop("s", "a"), m.middle, m.rights).join(m.pairs.withColumnsRenamed({"s": "s2", "a": "a2"}), "pair", "left").fillna(0, ["s2", "a2"])
    strength = BACK_OFF * m.scale  # an event seen for certain stands for scale open ones
    whole = p = F.least(F.lit(0.98), (_of(m.before, F.col("rc"), 0) * m.scale + 1) / (_of(m.before, F.col("rc"), 1) + 2))
    for s, a in (("s1", "a1"), ("s2", "a2")):
        p = F.least(F.lit(1.0), (F.col(s) * m.scale + strength * p) / (F.col(a) + strength))
    # only an event explains why a word is large that hardly ever is elsewhere, though it may begin no paragraph
    p = F.when(F.col("rc").endswith("+"), F.greatest(p, whole)).otherwise(p)
    # without a mark: paragraphs that begin so against the word in the middle of sentences
    few = _of(m.before, F.lit("none"), 0) / F.greatest(_of(m.before, F.lit("none"), 1), F.lit(1.0))
    bare = (F.col("s1") + BACK_OFF * few) / (F.col("s1") + F.col("large") + BACK_OFF)  # first words aren't in the middle
    return k.select("none", "pair", "word", "rc", F.when(F.col("none"), bare).otherwise(p).alias("p"))


def _with_before(rows: DataFrame, before: DataFrame) -> DataFrame:
    gaps = rows.filter(F.col("kind") == GAP).withColumn("none", F.col("lc") == "none").drop("rc")
    return gaps.join(before, ["none", "pair", "word"], "left").select("rid", "doc_id", "para", "idx", "e", "s", "left", "lc", "rc", "words", "inside", "none", "p")


def train(rows: DataFrame) -> Model:
    """The model of a corpus, from its gap_table."""
    return _fit(rows)[0]


def _fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the corpus' own gaps with the probabilities from the words behind them."""
    keys = stored(_keys(rows), "grams")
    seen = keys.filter("not none")
    middle = rows.filter(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n"))
    counted = lambda by: seen.groupBy(by).agg(F.sum("s").alias("s"), F.sum("a").alias("a"))
    rights, pairs = counted("right"), counted("pair")
    t = rows.agg(
        F.count_if((F.col("kind") == GAP) & F.col("strong")).alias("open"), F.count_if((F.col("kind") == START) & F.col("strong")).alias("end"),
        F.count_if(F.col("kind") == START).alias("starts"), F.sum(F.when(F.col("kind") == WORD, F.col("n"))).alias("words"), F.count_if(F.col("left").isNotNull() & (F.col("kind") == START)).alias("ends"),
    ).first()
    scale = (t["open"] + 1) / (t["end"] + 1) if t["end"] else 2.0
    # classes are some tens
    classes = {r["rc"]: (r["s"], r["a"]) for r in _classed(seen, middle, rights).groupBy("rc").agg(F.sum("s").alias("s"), F.sum("a").alias("a")).collect()}
    classes["none"] = t["starts"], t["starts"] + (t["words"] or 0)
    m = Model(scale, middle, rights, pairs, None, classes, {})
    # one step of EM for the words before marks; words without one: how often they end a paragraph
    gaps = stored(_with_before(rows, _before(keys.filter("a > 0 or none"), m)), "candidates")
    soft = gaps.filter("not none").groupBy("left", "lc")
    soft = stored(soft.agg(F.round(F.sum("p"), 6).alias("event"), F.count("*").cast("double").alias("gap")), "lefts")
    ends = rows.filter((F.col("kind") == START) & F.col("left").isNotNull()).groupBy("left").agg(F.count("*").cast("double").alias("event"))
    ends = ends.join(middle.withColumnRenamed("word", "left"), "left", "left").select("left", F.lit("none").alias("lc"), "event", F.greatest(F.col("event"), F.coalesce("n", F.lit(0))).cast("double").alias("gap"))
    after = {r["lc"]: (r["event"], r["gap"]) for r in soft.groupBy("lc").agg(F.sum("event").alias("event"), F.sum("gap").alias("gap")).collect()}
    after["none"] = t["ends"], t["ends"] + (t["words"] or 0)
    return Model(scale, middle, rights, pairs, soft.unionByName(ends), classes, after), gaps


def _log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.greatest(F.lit(-WEIGHT), F.least(F.lit(WEIGHT), F.log(q / (1 - q))))


def _scores(gaps: DataFrame, m: Model) -> DataFrame:
    """(rid, doc_id, para, idx, e, s, words, x): log odds of an event in each gap, from both sides and the priors."""
    g = gaps.join(m.lefts, ["left", "lc"], "left").fillna(0.0, ["event", "gap"])
    of = (_of(m.after, F.col("lc"), 0) + 1) / (_of(m.after, F.col("lc"), 1) + 2)
    # a word that never ended a paragraph, and isn't known in the middle either, says what its class says
    after = (F.col("event") + BACK_OFF * of) / (F.col("gap") + BACK_OFF)
    prior = F.when(F.col("lc").isin("word", "wordc") & F.col("rc").isin("Capital", "Capitalo", "Uppero", "Capital+", "Capitalo+"), PRIOR_WORD_CAPITAL).otherwise(0.0)
    prior = prior + F.when(F.col("inside"), PRIOR_IN_BRACKETS).otherwise(0.0)
    prior = prior + F.when(F.col("lc") == "none", PRIOR_NO_MARK).when(F.col("lc") == "thai", PRIOR_THAI).otherwise(0.0)
    return g.select("rid", "doc_id", "para", "idx", "e", "s", "words", (_log_odds(F.col("p")) + _log_odds(after) + prior).alias("x"))


def posteriors(score: list[float], pair: list[float]) -> list[float]:
    """Forward-backward over the gaps of a paragraph; the states are event and none. score: log odds of an event; pair:
    what an event weighs more where the one before it was an event too."""
    n = len(score)
    if not n:
        return []
    f0, f1 = [0.0] * n, [0.0] * n
    f1[0] = score[0] + pair[0]
    for i in range(1, n):
        f0[i] = _add(f0[i - 1], f1[i - 1])
        f1[i] = score[i] + _add(f0[i - 1], f1[i - 1] + pair[i])
    b0, b1 = 0.0, 0.0
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        up, down = f1[i] + b1, f0[i] + b0
        out[i] = 1 / (1 + exp(min(700.0, down - up)))
        if i:
            b0, b1 = _add(b0, score[i] + b1), _add(b0, score[i] + pair[i] + b1)
    return out


def _add(a: float, b: float) -> float:
    m = a if a > b else b
    return m + log(exp(a - m) + exp(b - m))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences from rows sorted by (rid, para, idx), each paragraph begun by its START (idx -1)."""
    for b in whole_groups(batches, ["rid"]):
        doc, begin, end, idx = b["doc_id"].to_numpy(), b["s"].to_numpy(), b["e"].to_numpy(), b["idx"].to_numpy()
        x, few = b["x"].to_numpy(), b["words"].to_numpy() <= 1
        docs, starts, ends = [], [], []
        heads = np.flatnonzero(idx < 0)
        for h, t in zip(heads, np.append(heads[1:], len(b))):
            at = begin[h]
            if t > h + 1:
                p = posteriors(x[h + 1 : t].tolist(), np.where(few[h + 1 : t], PRIOR_ONE_WORD, 0.0).tolist())
                for k in [h + 1 + i for i, v in enumerate(p) if v > 0.5]:
                    docs.append(doc[h])
                    starts.append(at)
                    ends.append(end[k])
                    at = begin[k]
            docs.append(doc[h])
            starts.append(at)
            ends.append(end[h])
        yield pd.DataFrame({"doc_id": np.array(docs, np.int64), "start_char": np.array(starts, np.int64), "end_char": np.array(ends, np.int64)})


def sentence_units(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence, from its first to after its last non-blank character.

    Code points count from 0, the end is exclusive; every non-blank character is in exactly one sentence. Null, empty
    and blank texts have none; a repeated row gives its sentences again. model: of train(); by default of documents.
    """
    rows = gap_table(documents)
    if model is None:
        m, gaps = _fit(rows)
    else:
        m, gaps = model, _with_before(rows, _before(_keys(rows.filter(F.col("kind") == GAP)), model))
    scored = _scores(gaps, m)
    starts = rows.filter(F.col("kind") == START).select("rid", "doc_id", "para", "idx", "e", "s", "words", F.lit(0.0).alias("x"))
    return starts.unionByName(scored).repartition("rid").sortWithinPartitions("rid", "para", "idx").mapInPandas(_units, "doc_id long, start_char long, end_char long")
