"""Text quality: basic counts, and the share of a text that is running prose.

A text is cut into lines, and every line into words, numbers, identifiers,
punctuation and symbols.  How these classes are distributed, the function words
of a language among them, is compared with structural profiles (prose of each
language, list, code, table, header, word list, encoded data) by
Jensen-Shannon divergence, and the nearest profile is assigned.  Lines nearest
to prose that follow each other make a passage; a passage counts as running
prose if it has sentences.

Everything works on the bytes of many texts at once, in arrays; no text is cut
short and no statistic is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 1 << 21

# Classes of bytes.
_BLANK, _BREAK, _LOWER, _UPPER, _DIGIT, _STOP, _INNER, _SYMBOL, _JOINT = range(9)

# Classes of tokens.
_FUNCTION, _PLAIN, _CAPITAL, _SHOUT, _NAME, _NUMBER, _POINT, _SIGN, _MARK = range(9)

#: Structural profiles as shares of the token classes, in the
#: order function word, other word, capitalised word, word in capitals,
#: identifier, number, sentence punctuation, other symbol, list mark.
PROFILES = {
    "prose": (0.42, 0.42, 0.05, 0.00, 0.01, 0.005, 0.09, 0.005, 0.00),
    "list": (0.20, 0.30, 0.04, 0.00, 0.06, 0.02, 0.03, 0.03, 0.32),
    "code": (0.02, 0.17, 0.04, 0.06, 0.23, 0.05, 0.15, 0.28, 0.00),
    "table": (0.00, 0.05, 0.03, 0.00, 0.12, 0.50, 0.17, 0.13, 0.00),
    "header": (0.04, 0.18, 0.22, 0.02, 0.12, 0.18, 0.12, 0.12, 0.00),
    "words": (0.06, 0.82, 0.06, 0.02, 0.02, 0.00, 0.02, 0.00, 0.00),
    "encoded": (0.00, 0.05, 0.10, 0.10, 0.40, 0.10, 0.05, 0.20, 0.00),
}
#: Function words in the prose of some languages, as a share of its words; and of any other.
FUNCTION_SHARE = {"en": 0.46, "de": 0.36, "fr": 0.38, "es": 0.38}
OTHER_SHARE = 0.40
#: Common words beyond this number are no list of function words; a parameter of ``text_quality``.
MOST_WORDS = 1_000_000

_OTHERS = [p for p in PROFILES if p != "prose"]


def structures(langs: list[str]) -> list[str]:
    """The profiles there are for some languages: prose in each, then the others."""
    return [*[f"prose_{lang}" for lang in langs], *_OTHERS]


def _byte_classes() -> np.ndarray:
    c = np.full(256, _SYMBOL, np.uint8)
    c[[9, 11, 12, 13, 32]] = _BLANK
    c[10] = _BREAK
    c[97:123] = _LOWER
    c[128:] = _LOWER
    c[65:91] = _UPPER
    c[48:58] = _DIGIT
    c[[ord(x) for x in ".?!"]] = _STOP
    c[[ord(x) for x in ",;:'\"()-"]] = _INNER
    c[ord("_")] = _JOINT
    return c


_CLASS = _byte_classes()


_HEAD = 16


def _heads(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 16 bytes of each word as two numbers, and a key made from them and the length."""
    first, second = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    some = np.arange(len(start))
    for j in range(_HEAD):
        some = some[length[some] > j]  # fewer at every step
        if not len(some):
            break
        (first if j < 8 else second)[some] |= data[start[some] + j].astype(np.uint64) << np.uint64(8 * (j % 8))
    with np.errstate(over="ignore"):
        key = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + length.astype(np.uint64)
    return first, second, key


class Words:
    """The common words of any number of languages, looked up by their bytes.

    A key finds the candidate; the bytes decide.  Words may be of any length.
    """

    def __init__(self, common: dict[str, list[str]]):
        self.langs = sorted(lang for lang, words in common.items() if words)
        of: dict[bytes, set[int]] = {}
        for i, lang in enumerate(self.langs):
            for w in common[lang]:
                if raw := w.lower().encode("utf-8", "replace"):
                    of.setdefault(raw, set()).add(i)
        raw = list(of)
        data = np.frombuffer(b"".join(raw) or b" ", np.uint8)
        length = np.array([len(w) for w in raw], np.int64)
        first, second, key = _heads(data, np.cumsum(length) - length, length)
        order = np.argsort(key, kind="stable")
        self.words, self.length, self.longest = [raw[i] for i in order], length[order], int(length.max(initial=0))
        self.first, self.second, self.key = first[order], second[order], key[order]
        # A last row for what is no common word.
        self.member = np.zeros((len(raw) + 1, len(self.langs)), bool)
        for row, i in enumerate(order):
            self.member[row, list(of[raw[i]])] = True

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The row of each word of ``data``, or the last one."""
        none = len(self.words)
        out = np.full(len(start), none, np.int64)
        if not none or not len(start):
            return out
        near = np.flatnonzero(length <= self.longest)
        out[near] = self._find(data, start[near], length[near])
        return out

    def _find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        none = len(self.words)
        out = np.full(len(start), none, np.int64)
        first, second, key = _heads(data, start, length)
        at = np.searchsorted(self.key, key)
        todo = np.flatnonzero((at < none) & (self.key[np.minimum(at, none - 1)] == key))
        while len(todo):  # once, but for words that share a key
            i = at[todo]
            same = (self.first[i] == first[todo]) & (self.second[i] == second[todo]) & (self.length[i] == length[todo])
            for k in np.flatnonzero(same & (length[todo] > _HEAD)):
                w = todo[k]
                same[k] = data[start[w] : start[w] + length[w]].tobytes() == self.words[i[k]]
            out[todo[same]] = i[same]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[(at[todo] < none) & (self.key[np.minimum(at[todo], none - 1)] == key[todo])]
        return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` from the distribution ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return (left + right) / 2


def _nearest(function: np.ndarray, rest: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest structure and its divergence; ``function``: tokens by language, ``rest``: n x 9 counts with all words in the other classes."""
    total = np.maximum(rest.sum(axis=1), 1)
    far = []
    for i, lang in enumerate(langs):
        share, q = FUNCTION_SHARE.get(lang, OTHER_SHARE), np.array(PROFILES["prose"])
        words = q[_FUNCTION] + q[_PLAIN] + q[_CAPITAL]
        q = q.copy()
        q[_FUNCTION], q[_PLAIN] = words * share, words * (1 - share) - q[_CAPITAL]
        p = rest.astype(float)
        p[:, _FUNCTION] = function[:, i]
        p[:, _PLAIN] = np.maximum(p[:, _PLAIN] - function[:, i], 0)
        far.append(divergence(p / total[:, None], q))
    best = function.max(axis=1, initial=0)
    p = rest.astype(float)
    p[:, _FUNCTION] = best
    p[:, _PLAIN] = np.maximum(p[:, _PLAIN] - best, 0)
    p /= total[:, None]
    far += [divergence(p, np.array(PROFILES[s])) for s in PROFILES if s != "prose"]
    table = np.stack(far, axis=1)
    at = np.argmin(table, axis=1)
    return at, table[np.arange(len(at)), at]


def measure(texts: list[bytes], common: Words) -> dict[str, np.ndarray]:
    """The statistics of each text, in arrays."""
    n_docs, langs = len(texts), common.langs
    names = structures(langs)
    place = np.int32 if sum(map(len, texts)) + n_docs < 2**31 else np.int64  # half the memory for one long text
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts], np.int64) + 1
    doc_at = np.cumsum(size) - size
    kind = _CLASS[data]
    # Bytes E2 80 xx are dashes, quotes, dots and bullets, not letters.
    general = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.zeros(0, np.int64)
    if len(general):
        kind = kind.copy()
        for j in range(3):
            kind[general + j] = _INNER
        bullets = general[data[general + 2] == 0xA2]
        kind[bullets] = _SYMBOL
    folded = np.where(kind == _UPPER, data | 0x20, data)
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    if len(accent):
        folded[accent] |= 0x20
        kind = kind if kind.flags.owndata else kind.copy()

    breaks = np.flatnonzero(kind == _BREAK)
    line_at = np.r_[0, breaks[:-1] + 1]
    n_lines = len(line_at)
    line_doc = np.searchsorted(doc_at, line_at, side="right") - 1
    lead = (data & 0xC0) != 0x80  # one a character
    visible = (kind != _BLANK) & (kind != _BREAK) & lead
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), line_at)
    line_chars = count(visible)

    # Tokens: runs of letters, digits and joints.
    inside = (kind == _LOWER) | (kind == _UPPER) | (kind == _DIGIT) | (kind == _JOINT)
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = stop - start
    tok_line = np.searchsorted(line_at, start, side="right") - 1
    sums = lambda k: (lambda c: c[stop] - c[start])(np.r_[0, np.cumsum(kind == k, dtype=np.int32)])
    upper, digit, joint = sums(_UPPER), sums(_DIGIT), sums(_JOINT)
    letters = length - digit - joint
    number = letters + joint == 0
    first_upper = kind[start] == _UPPER
    all_upper = (upper == letters) & (letters > 1)
    word = (digit == 0) & (joint == 0)
    camel = word & (upper > first_upper) & ~all_upper
    word &= ~camel
    row = np.full(len(start), len(common.words), np.int64)
    row[word] = common.find(folded, start[word], length[word])
    is_common = row < len(common.words)

    # A line in capitals is read as if it were not.
    per = lambda mask, w=None: np.bincount(tok_line[mask], weights=w, minlength=n_lines).astype(np.int64)
    words = per(word)
    shout_line = per(word & all_upper) * 10 >= np.maximum(words, 1) * 9
    shouting = shout_line[tok_line]
    cap = word & first_upper & ~all_upper
    shout = word & all_upper & ~shouting & ~is_common
    # The first word of a line or sentence is as good as in lower case.
    stack = lambda columns, n: np.stack(columns, axis=1) if columns else np.zeros((n, 0), np.int64)
    function = stack([per(common.member[row, i]) for i in range(len(langs))], n_lines)
    rest = np.zeros((n_lines, 9), np.int64)
    rest[:, _PLAIN] = words - per(cap & ~is_common) - per(shout)
    rest[:, _CAPITAL] = per(cap & ~is_common)
    rest[:, _SHOUT] = per(shout)
    rest[:, _NAME] = per(~word & ~number)
    rest[:, _NUMBER] = per(number)
    rest[:, _POINT] = count((kind == _STOP) | (kind == _INNER) & lead)
    rest[:, _SIGN] = count((kind == _SYMBOL) & lead)

    # Where the body of a line begins, behind a mark of a diff or quotation and blanks.
    every = np.arange(len(data), dtype=place)
    shown = np.where(kind != _BLANK, every, place(len(data) - 1))
    nxt = np.minimum.accumulate(shown[::-1])[::-1]
    last = len(data) - 1
    go = lambda p: nxt[np.minimum(p, last)]
    p0 = line_at
    marked = np.isin(data[p0], np.frombuffer(b"+->", np.uint8))
    rest[:, _SIGN] -= marked & (kind[p0] == _SYMBOL)
    rest[:, _POINT] -= marked & (kind[p0] == _INNER)
    body = go(np.where(marked, p0 + 1, p0))
    again = data[body] == ord(">")  # quoted, perhaps twice, perhaps indented
    rest[:, _SIGN] -= again
    body = go(np.where(again, body + 1, body))
    b0, b1, b2, b3 = (data[np.minimum(body + j, last)] for j in range(4))
    blank1, blank3 = _CLASS[b1] == _BLANK, _CLASS[b3] == _BLANK
    bullet = np.isin(b0, np.frombuffer(b"*-+o", np.uint8)) & blank1
    bullet |= (data[p0] == ord("-")) & (data[np.minimum(p0 + 1, last)] == 32) & (data[np.minimum(p0 + 2, last)] > 32)
    bullet |= (b0 == 0xE2) & (b1 == 0x80) & (b2 == 0xA2)
    bullet |= (b0 == ord("[")) & (b2 == ord("]")) & blank3
    # A number and a dot or bracket, of up to four digits.
    end = body.copy()
    for _ in range(4):
        end += _CLASS[data[np.minimum(end, last)]] == _DIGIT
    numbered = (end > body) & np.isin(data[np.minimum(end, last)], np.frombuffer(b".)", np.uint8)) & (_CLASS[data[np.minimum(end + 1, last)]] == _BLANK)
    # A number that a wrapped sentence carried to the start of a line is no mark.
    trimmed = np.maximum.accumulate(np.where((kind != _BLANK) & (kind != _BREAK), every, place(0)))
    tail = trimmed[np.maximum(breaks - 1, 0)]
    opened = (line_chars > 0) & ~bullet & ~numbered & (words >= 4) & (kind[tail] != _STOP)
    bullet |= numbered & ~(np.r_[False, opened[:-1]] & (line_doc == np.r_[-1, line_doc[:-1]]))
    # The mark of an item counts half as much as all that the item says.
    rest[:, _MARK] = np.where(bullet, np.maximum(1, rest.sum(axis=1) // 2), 0)

    # The nearest structure of each line with anything in it.
    structure = np.full(n_lines, -1, np.int64)
    some = np.flatnonzero(line_chars > 0)
    structure[some] = _nearest(function[some], rest[some], langs)[0]

    # Sentence ends: a stop before a blank or the end of the line, perhaps behind a closing quote or bracket.
    after = np.r_[kind[1:], _BREAK]
    closing = np.isin(data, np.frombuffer(b"\")'", np.uint8))
    after2 = np.r_[kind[2:], _BREAK, _BREAK]
    ends_word = (after == _BLANK) | (after == _BREAK) | (np.r_[closing[1:], False] & ((after2 == _BLANK) | (after2 == _BREAK)))
    stops = count((kind == _STOP) & ends_word)
    filled = line_chars > 0
    punct_end = filled & ((kind[tail] == _STOP) | np.isin(data[tail], np.frombuffer(b";:,", np.uint8)))
    odd = [names.index("header"), names.index("table")]

    # Passages: lines of words that follow each other.  A line alone says little; a passage has a distribution.
    tokens = np.maximum(rest.sum(axis=1), 1)
    strange = rest[:, _NAME] + rest[:, _SIGN] + rest[:, _NUMBER]
    wordy = filled & ~bullet & (words >= 1) & (strange <= 0.4 * tokens) & ~(np.isin(structure, odd) & ((words >= 3) | (strange > 0)))
    same_doc = line_doc == np.r_[-1, line_doc[:-1]]
    begins = wordy & ~(np.r_[False, wordy[:-1]] & same_doc)
    in_lines = np.flatnonzero(wordy)
    passage = (np.cumsum(begins) - 1)[in_lines]
    k = int(begins.sum())
    add = lambda v: np.bincount(passage, weights=v[in_lines], minlength=k)
    p_function = stack([add(function[:, i]) for i in range(len(langs))], k)
    p_rest = np.stack([add(rest[:, i]) for i in range(9)], axis=1)
    p_words, p_stops, p_lines = add(words), add(stops), add(np.ones(n_lines))
    near = _nearest(p_function, p_rest, langs)[0] if k else np.zeros(0, np.int64)
    # Sentences have a stop now and then and go on over the line; lines of a list stop and start anew.
    running = (near < len(langs)) & (p_stops >= 1) & (p_words >= 4 * p_stops) & (p_words <= 80 * p_stops) & (p_words >= 4 * p_lines) & (p_function.max(axis=1, initial=0) >= 0.2 * p_words)
    prose = np.zeros(n_lines, bool)
    prose[in_lines] = running[passage]

    by_doc = lambda v: np.bincount(line_doc, weights=v, minlength=n_docs)
    chars, n_words = by_doc(line_chars), by_doc(words)
    word_chars = np.zeros(n_lines)
    if word.any():
        character = np.r_[place(0), np.cumsum(lead, dtype=place)]
        word_chars = np.bincount(tok_line[word], weights=(character[stop] - character[start])[word], minlength=n_lines)
    f_doc = stack([by_doc(function[:, i]) for i in range(len(langs))], n_docs)
    rest_doc = np.stack([by_doc(rest[:, i]) for i in range(9)], axis=1)
    near, far = _nearest(f_doc, rest_doc, langs)
    ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    return {
        "n_words": n_words.astype(np.int64),
        "mean_word_length": ratio(by_doc(word_chars), n_words),
        "symbol_ratio": ratio(by_doc(rest[:, _SIGN]), chars),
        "punctuated_lines": ratio(by_doc(punct_end), by_doc(filled)),
        "common_words": ratio(f_doc.max(axis=1, initial=0), n_words),
        "prose_share": ratio(by_doc(np.where(prose, line_chars, 0)), chars),
        "structure": np.where(chars > 0, near, -1),
        "divergence": np.where(chars > 0, far, 0.0),
        "_line_doc": line_doc, "_prose": prose, "_line_structure": structure,
    }


def text_quality(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """``(key, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words, prose_share, structure, divergence)`` for each row.

    ``common_words`` has ``lang`` and ``word``: the function words of any
    number of languages, each of any length; they are sent to all tasks, so
    there may be ``most_words`` of them at most, which is checked.  A null,
    empty or blank text has no words, shares of 0 and a null ``structure``.
    Invalid bytes count as letters.
    Repeated rows give repeated results; an empty table gives an empty one.
    """
    words = common_words.where("word is not null and lang is not null").select("lang", "word").distinct().limit(most_words + 1).toPandas()
    if len(words) > most_words:
        raise ValueError(f"common_words must hold at most {most_words} words")
    common = Words({lang: mine.tolist() for lang, mine in words.groupby("lang")["word"]})
    sent, labels = docs.sparkSession.sparkContext.broadcast(common), structures(common.langs)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    names = ["n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "prose_share", "structure", "divergence"]

    def score(batches):
        for b in batches:
            texts = [t.encode("utf-8", "replace") if t else b"" for t in b.column(1).to_pylist()]
            a = 0
            while a < len(texts):
                z, held = a, 0
                while z < len(texts) and (z == a or held + len(texts[z]) <= _CHUNK):
                    held += len(texts[z])
                    z += 1
                m = measure(texts[a:z], sent.value)
                structure = pa.array([labels[i] if i >= 0 else None for i in m["structure"]], pa.string())
                columns = [structure if c == "structure" else pa.array(m[c]) for c in names]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *columns], ["_key", *names])
                a = z

    kind = dict(rows.dtypes)["_key"]
    schema = f"_key {kind}, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, prose_share double, structure string, divergence double"
    return rows.mapInArrow(score, schema).withColumnRenamed("_key", key)


def prose(quality: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of :func:`text_quality` whose running prose makes up more than ``least`` of the visible characters."""
    return quality.where((F.col("prose_share") > least) & F.col("structure").isNotNull())
