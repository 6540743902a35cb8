"""Sentence units of texts in many languages and scripts.

Characters are tagged boundary or inside by a linear-chain model. Only characters that end a possible sentence
(an end mark with the closing quotes and brackets behind it, or a space in Thai) can be boundaries; for all
others the tag is certain, so the chain runs over those places and over quotes and brackets. Its state is the
closing mark that the text waits for and the tag of the last place outside quotes and brackets; going from one
tag to the next has a weight. Viterbi finds the best path.

The weights are trained here, on the corpus itself and without labels. Emissions: the ends of paragraphs are
true sentence ends and their starts true starts. How often a token with its end mark ends a paragraph against
how often it stands inside tells abbreviations from sentence ends; how often a token starts a paragraph tells
whether a sentence can begin with it. Transitions: counted between neighbouring places whose tags are plain (a
long word with an end mark before a capital, an end mark before a small letter). Thai has no end marks, so its
words are counted without any mark; that a Thai space ends a sentence is given by the task and enters as its
prior (THAI_SPACE). The statistics cover all documents. They live in a table of hashed features of fixed size
(BUCKETS), so the model doesn't grow with the corpus; it can be kept (``save``, ``restore``) and used again.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: Prior weight of a shape against a token's own counts, log-odds of a boundary before any evidence, price of
#: a boundary inside a quotation or bracket, of a mark that opens or closes nothing, and the worth of a Thai space.
BACKOFF, BIAS, WITHIN, STRAY, THAI_SPACE = 4.0, 1.1, 8.0, 3.0, 3.0
FLOOR = -6.0
#: Weight of the tags' own shares against the counted transitions.
CHAIN = 10.0

# End marks, marks that close, pairs, scripts.
_END = ".!?…。！？｡؟۔।॥;;"
_WIDE = "。！？｡…"
_CLOSE = "\"'”’“‘»›)]}」』）】〉》*_`"
_OPEN = "\"'“‘«„‚([{¿¡"
_QUOTE, _QUOTED = "\"“«„", "\"”»“"
_DOTTED = regex.compile(r"\w\.[a-z]")
_PAIRS = dict(zip("«“‘(（[「『【〈《„‹‚", "»”’)）]」』】〉》“›‘"))
_SPACED = ("Latin", "Cyrillic", "Greek", "Hangul", "Devanagari", "Arabic", "Hebrew")
_SCRIPT = regex.compile("|".join(rf"(?P<{s}>\p{{{s}}})" for s in (*_SPACED, "Thai", "Han", "Hiragana", "Katakana")))
_CASED = {"Latin", "Cyrillic", "Greek"}
_DENSE = {"Han", "Hiragana", "Katakana"}
_UNSPACED = _DENSE | {"Thai"}
_EDGE = set(_END + _CLOSE)
_FENCE = regex.compile(r"[ \t]*(```+|~~~+)")
_LINE_UNIT = regex.compile(r"\s*(?:#+(?:\s|$)|[-*] |[0-9]+\. )")
_MARKED = rf"(?P<end>[{regex.escape(_END)}]+)(?P<close>(?:[{regex.escape(_CLOSE)}]|[\u00a0\u202f ](?=»))*)(?=\s)|(?P<wide>(?:[.!?]*[{_WIDE}])++[.!?]*+)(?P<wclose>[{regex.escape(_CLOSE)}]*+)(?=\S)(?![{regex.escape(_END)}])"
_SPACES = r"(?<=\p{Thai})(?P<gap>[^\S\n]+)(?=\S)|(?<=\S)(?P<gap2>[^\S\n]+)(?=\p{Thai})"
_PLACE, _THAI_PLACE, _THAI = regex.compile(_MARKED), regex.compile(f"{_MARKED}|{_SPACES}"), re.compile("[\u0e00-\u0e7f]")
_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_MARK = re.compile(r"[\"'“”‘’‚«»„‹›()（）\[\]「」『』【】〈〉《》]")
_NEXT = regex.compile(r"\S{1,40}")
_STRONG = regex.compile(r"\p{Ll}{4,}[.?]")
_WORD = regex.compile(r"\p{Ll}{4,}\.|(?:\p{Lo}\p{M}*){2,}[.!?؟۔।॥]+")
_DENSE_END = regex.compile(r".*[\p{L}\p{N}ー）)\]】][.!?]*[。！？｡][.!?。！？｡]*", regex.S)
_NUMBER = regex.compile(r"[0-9]{1,4}\.")


def blocks(text: str):
    """``start, end, is_unit`` of the blocks of a text: fenced code, heading and list lines are units, all
    else are paragraphs, which blank lines end. Ends exclude white space; empty blocks are left out."""
    at, open_at, fence, para = 0, -1, "", -1
    last = 0

    def trimmed(a: int, b: int):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    for line in _LINE.findall(text):
        if not line:
            continue
        stop = at + len(line)
        mark = _FENCE.match(line)
        if open_at >= 0:
            if mark and mark[1].startswith(fence) and not line[mark.end():].strip():
                yield (*trimmed(open_at, stop), True)
                open_at = -1
        else:
            whole = bool(_LINE_UNIT.match(line))
            if (mark or whole or not line.strip()) and para >= 0:
                yield (*trimmed(para, last), False)
                para = -1
            if mark:
                open_at, fence = at, mark[1]
            elif whole:
                yield (*trimmed(at, stop), True)
            elif line.strip() and para < 0:
                para = at
        at = last = stop
    if open_at >= 0:
        yield (*trimmed(open_at, at), True)
    elif para >= 0:
        yield (*trimmed(para, at), False)


def _script(s: str) -> str:
    m = _SCRIPT.search(s)
    return m.lastgroup if m else "other"


def _case(c: str) -> str:
    return "U" if c.isupper() else "l" if c.islower() else "9" if c.isdigit() else "o" if c.isalpha() else c


def before(text: str, stop: int) -> str:
    """The token that ends at ``stop`` with its end mark and closers, at most 40 characters of it. A whole number
    with a full stop can be an ordinal, so it comes with the word before it."""
    near = text[max(0, stop - 40): stop]
    if near[-1] == "»" and near[-2:-1].isspace():
        head = near[:-2]
        return ("" if not head or head[-1].isspace() else head.rsplit(None, 1)[-1]) + near[-2:]
    token = near.rsplit(None, 1)[-1]
    if token[-1] == "." and _NUMBER.fullmatch(token):
        return " ".join(near.rsplit(None, 2)[-2:])
    return token


def left_keys(token: str) -> tuple[str, str, str]:
    """Own key (or ''), shape and script of the token before a place."""
    rest = token.rstrip(_CLOSE + "\u00a0\u202f ")
    close = "".join(token[len(rest):].split())
    word = rest.rstrip(_END)
    end = rest[len(word):]
    word = word.lstrip(_OPEN)
    kind = _script(word[::-1]) if word else "other"
    mark = end[-1:] + ("+" if len(end) > 1 else "")
    if kind in _DENSE or end not in (".", ""):
        return "", f"L|{'dense' if kind in _DENSE else kind}|{mark}|{close}", kind
    plain = regex.sub("[0-9]+", "9", word)
    if kind == "Thai":
        if not end:
            mark = close = ""
        return f"l|{word[-4:]}{end}{close}", f"L|Thai|{mark}|{close}", kind
    letters = sum(map(str.isalpha, word))
    shape = f"L|{kind}|{min(letters, 4)}|{_case(word[:1])}|{'.' in word}|{'9' in plain}|{mark}|{close}"
    return f"l|{plain}{end}{close}", shape, kind


def right_keys(token: str) -> tuple[str, str, str]:
    """Own key (or ''), shape and script of the token a sentence would begin with."""
    kind = _script(token)
    if kind in _DENSE:
        return f"r|{token[: 1 if token[0].isalpha() else 2]}", f"R|dense|{kind if token[0].isalpha() else token[0]}", "dense"
    if kind == "Thai":
        return f"r|{token[:3]}", "R|Thai", kind
    plain = regex.sub("[0-9]+", "9", token)
    head = regex.search(r"[\p{L}\p{N}]", token)
    opener = "".join(sorted(set(token[: head.start()] if head else token[:2])))
    quoted = kind in _CASED and not set(opener).isdisjoint("\"'“«„‘")  # the word in a quotation says little
    return "" if quoted else f"r|{plain}", f"R|{kind}|{opener}|{_case(head[0]) if head else ''}|{bool(_DOTTED.search(token))}", kind


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode()) & (BUCKETS - 1)


def places(text: str):
    """Possible boundaries of a paragraph: ``end of the sentence, start of the next, is a Thai space``."""
    last = 0
    thai = bool(_THAI.search(text))
    for m in (_THAI_PLACE if thai else _PLACE).finditer(text):
        if thai and (m["gap"] or m["gap2"]):
            if m.end() > last:  # else an end mark stands before this space
                yield m.start(), m.end(), True
            continue
        if m["end"]:
            greek = ";" in m["end"] or ";" in m["end"]
            if greek and _script(text[max(0, m.start() - 3): m.start()][::-1]) != "Greek":
                continue
        elif "…" in m["wide"] and not set(m["wide"]) & set("。！？｡") and _script(text[max(0, m.start() - 1): m.start()]) not in _DENSE:
            continue
        start = m.end()
        while start < len(text) and text[start].isspace():
            start += 1
        if start < len(text):
            last = start
            yield m.end(), start, False


def stripped(token: str) -> str:
    """A Thai token without end marks and closers; any other as it is."""
    if _THAI.search(token):
        return token.rstrip(_END + _CLOSE) or token
    return token


def _evidence(text: str, lefts: Counter, rights: Counter, tokens: Counter, chain: Counter) -> None:
    """Add one paragraph: tokens before and after its places and at its edges, all its other tokens, and the tags
    of neighbouring places where both are plain."""
    found = list(places(text))
    within = _within(text) if found else None
    last = 1  # a paragraph begins like a sentence
    for stop, start, gap in found:
        if within(stop):
            continue  # sentences inside a quotation or bracket say nothing about the text's own
        token = before(text, stop)
        lefts[stripped(token) if gap else token, 0] += 1
        first, tag = text[start], None
        if first.isupper():
            if _STRONG.fullmatch(token):
                follows = _NEXT.match(text, start)[0]
                rights[follows, 1] += 1  # as good as a paragraph's start
                rights[follows, 0] -= 1  # it is counted with all tokens below
                tag = 1
        elif first.islower():
            tag = 0
        elif _script(text[start: start + 2]) in _UNSPACED:
            rights[text[start: start + 3], 0] += 1
        if tag is not None and last is not None:
            chain[last, tag] += 1
        last = tag
    if text[-1] in _EDGE or _THAI.match(text[-1]):
        lefts[stripped(before(text, len(text))), 1] += 1
    first, *rest = text.split()
    rights[first[:40], 1] += 1
    tokens.update(rest)


def _within(text: str):
    """Whether a position lies inside quotes or brackets that close again, by plain pairing."""
    starts, stops, waits = [], [], []
    for i, ch, way in _marks(text):
        if waits and ch == waits[-1][1] and way != "open":
            start = waits.pop()[0]
            while starts and starts[-1] > start:  # only the outermost spans count
                starts.pop()
                stops.pop()
            starts.append(start)
            stops.append(i)
        elif way != "close":
            waits.append((i, _PAIRS.get(ch, ch)))

    def within(at: int) -> bool:
        k = bisect_left(starts, at) - 1
        return k >= 0 and at <= stops[k]

    return within


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of every feature bucket, inside and at paragraph edges, and two rows more for the tags that follow an
    inside and a boundary: an array of fixed size.

    Tasks count their own documents; one row per bucket shuffles and reaches the driver.
    """
    def run(batches):
        lefts, rights, tokens, chain = Counter(), Counter(), Counter(), Counter()

        def flush():
            rows = Counter()
            for counts, keys_of, side in ((lefts, left_keys, "l"), (rights, right_keys, "r")):
                for (token, edge), n in counts.items():
                    own, shape, kind = keys_of(token)
                    for k in (own, shape, f"B|{side}|{kind}"):
                        if k:
                            rows[_bucket(k), edge] += n
                counts.clear()
            for token, n in tokens.items():
                own, shape, kind = right_keys(token[:40])
                if kind not in ("dense", "Thai"):
                    for k in (own, shape, f"B|r|{kind}"):
                        if k:
                            rows[_bucket(k), 0] += n
            tokens.clear()
            for (last, tag), n in chain.items():
                rows[BUCKETS + last, tag] += n
            chain.clear()
            if rows:
                b, e = zip(*rows)
                yield pa.record_batch([pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["bucket", "edge", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                for a, b, unit in blocks(value):
                    if not unit and b > a:
                        _evidence(value[a:b], lefts, rights, tokens, chain)
                if len(tokens) + len(lefts) > 300_000:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(text).alias("text")).where("text is not null and text <> ''").mapInArrow(run, "bucket int, edge int, n bigint")
    model = np.zeros((BUCKETS + 2, 2))
    for r in rows.groupBy("bucket", "edge").agg(F.sum("n").alias("n")).toLocalIterator():
        model[r["bucket"], r["edge"]] = r["n"]
    return model


class Tagger:
    """Viterbi over the places of a paragraph with trained emissions."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.lefts: dict[str, tuple[float, bool]] = {}
        self.rights: dict[str, float] = {}
        #: change[last][tag]: log of the share of a tag behind another, against its share overall.
        counts = np.asarray(model[BUCKETS:], dtype=float)
        share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 1)
        follow = (counts + CHAIN * share) / (counts.sum(axis=1, keepdims=True) + CHAIN)
        self.change = np.log(follow / share).tolist()

    def _share(self, key: str) -> tuple[float, float]:
        inside, edge = self.model[_bucket(key)]
        return edge, inside

    def _score(self, own: str, shape: str, base: str) -> float:
        edge, inside = self._share(base)
        q = (edge + 0.5) / (edge + inside + 5)
        edge, inside = self._share(shape)
        p = (edge + BACKOFF * q) / (edge + inside + BACKOFF)
        if own:
            edge, inside = self._share(own)
            p = (edge + BACKOFF * p) / (edge + inside + BACKOFF)
        return max(FLOOR, math.log(max(p, 1e-9) / q))

    def left(self, token: str) -> float:
        own, shape, kind = left_keys(token)
        if not own and kind in _CASED:
            return 0.0  # not a full stop: what follows decides
        return min(0.5, self._score(own, shape, f"B|l|{kind}"))

    def right(self, token: str) -> float:
        own, shape, kind = right_keys(token)
        score = min(3.0, self._score(own, shape, f"B|r|{kind}"))
        return max(score, -0.5) if _DOTTED.search(token) else score  # a file name can stand anywhere

    def _before(self, token: str) -> tuple[float, bool]:
        """Worth of the token before a place, and whether it is a plain word that does end sentences (small letters or
        a script of one case), so that what follows needs no evidence."""
        known = self.lefts.get(token)
        if known is None:
            if len(self.lefts) > 300_000:
                self.lefts.clear()
            s = self.left(token)
            known = self.lefts[token] = s, s > -0.5 and bool(_WORD.fullmatch(token) or _DENSE_END.fullmatch(token))
        return known

    def _after(self, token: str) -> float:
        known = self.rights.get(token)
        if known is None:
            if len(self.rights) > 300_000:
                self.rights.clear()
            known = self.rights[token] = self.right(token)
        return known

    def emission(self, text: str, stop: int, start: int, thai: bool) -> float:
        """Log-odds of a boundary at a place."""
        token = before(text, stop)
        if thai:
            return THAI_SPACE + max(-2.0, self._before(stripped(token))[0])
        s, plain = self._before(token)
        follows = self._after(_NEXT.match(text, start)[0])
        if start > stop:
            if token[-1] in _QUOTED and text[start] in _QUOTE:
                s, follows = max(s, -0.5), max(follows, 0.0)  # one speaker after another
            elif token[-1] in "!?" and text[start] > "\u3000" and _script(text[start]) in _DENSE:
                plain = True
        return BIAS + s + (max(follows, -0.5) if plain else follows)

    def cut(self, text: str) -> list[tuple[int, int]]:
        """Units of a paragraph, positions within it."""
        found = list(places(text))
        if not found:
            return [(0, len(text))] if text else []
        marks = [(i, 1, ch, way) for i, ch, way in _marks(text)]
        path = self._chain(text, found, marks) if marks else self._plain_chain(text, found)
        cuts = []
        while path:
            cuts.append(path[:2])
            path = path[2]
        units, at = [], 0
        for stop, start in reversed(cuts):
            units.append((at, stop))
            at = start
        return [*units, (at, len(text))]

    def _plain_chain(self, text: str, found: list):
        """Best path of a text without quotes and brackets: the state is the last tag alone."""
        (ii, ib), (bi, bb) = self.change
        inside, inside_path, edge, edge_path = -1e9, None, 0.0, None
        for stop, start, thai in found:
            s = self.emission(text, stop, start, thai)
            from_edge, from_inside = edge + s + bb, inside + s + ib
            stay_edge, stay_inside = edge + bi, inside + ii
            after = (stop, start, edge_path if from_edge >= from_inside else inside_path)
            inside_path = edge_path if stay_edge >= stay_inside else inside_path
            edge, inside, edge_path = max(from_edge, from_inside), max(stay_edge, stay_inside), after
        return edge_path if edge > inside else inside_path

    def _chain(self, text: str, found: list, marks: list):
        """Best path of any text."""
        events = [(stop, 0, start, thai) for stop, start, thai in found] + marks  # a place lies before the mark at its end
        events.sort(key=lambda e: e[:2])
        # Viterbi: state = closing mark the path waits for ('' outside) and the last tag outside; value = score and
        # the boundaries so far.
        best: dict[tuple[str, int], tuple[float, tuple | None]] = {("", 1): (0.0, None)}
        change = self.change
        for at, is_mark, x, y in events:
            new: dict[tuple[str, int], tuple[float, tuple | None]] = {}

            def offer(state: tuple[str, int], score: float, path, new=new):
                if state not in new or new[state][0] < score:
                    new[state] = (score, path)

            if not is_mark:
                s = self.emission(text, at, x, y)
                for (waits, last), (score, path) in best.items():
                    if waits:
                        offer((waits, last), score + max(s - WITHIN, 0), (at, x, path) if s > WITHIN else path)
                    else:
                        offer(("", 1), score + s + change[last][1], (at, x, path))
                        offer(("", 0), score + change[last][0], path)
            else:
                for (waits, last), (score, path) in best.items():
                    offer((waits, last), score - STRAY, path)  # the mark stands for nothing
                    if not waits and y != "close":
                        offer((_PAIRS.get(x, x), last), score, path)
                    elif waits and x == waits and y != "open":
                        offer(("", last), score, path)
                    elif waits and x != waits:
                        offer((waits, last), score, path)  # another kind of mark inside a quotation or bracket
            best = new
        return max(((score - (STRAY if waits else 0), path) for (waits, _), (score, path) in best.items()), key=lambda v: v[0])[1]


def _marks(text: str):
    """Quotes and brackets of a paragraph: position, mark, and whether it can only open or only close."""
    low = high = single = 0  # open „ and ‚ that “ and ‘ would close, and open ‘
    for m in _MARK.finditer(text):
        i, ch = m.start(), m[0]
        if ch in "\"'‘’":
            before, after = text[i - 1: i], text[i + 1: i + 2]
            starts = not before or before.isspace() or before in "([{（「—"
            ends = not after or not (after.isalnum() or after == "_")
            if ch != '"' and not (starts ^ ends):
                continue  # an apostrophe
            if ch == "‘":
                if ends and high:
                    high -= 1
                    way = "close"
                elif starts:
                    single += 1
                    way = "open"
                else:
                    continue
            elif ch == "’":
                if not ends or not single:
                    continue  # an apostrophe too
                single -= 1
                way = "close"
            else:
                way = "open" if starts and not ends else "close" if ends and not starts else "any"
        elif ch == "“":
            way = "close" if low > 0 else "open"
            low -= 1
        else:
            low += ch == "„"
            high += ch == "‚"
            way = "open" if ch in _PAIRS else "close"
        yield i, ch, way


def save(model: np.ndarray, spark, place: str) -> None:
    """Keep a model as a table."""
    at, edge = np.nonzero(model)
    rows = zip(at.tolist(), edge.tolist(), model[at, edge].tolist())
    spark.createDataFrame(list(rows), "bucket int, edge int, n double").coalesce(1).write.mode("overwrite").parquet(place)


def restore(spark, place: str) -> np.ndarray:
    """A kept model."""
    model = np.zeros((BUCKETS + 2, 2))
    for r in spark.read.parquet(place).toLocalIterator():
        model[r["bucket"], r["edge"]] = r["n"]
    return model


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """``doc_id, start_pos, end_pos``: every unit of every document, positions in code points, end exclusive.

    Null, empty and blank texts have no unit. Every character that isn't white space lies in exactly one unit;
    units neither begin nor end with white space. Texts are taken whole; no shuffle. Without ``model`` it is
    trained on the same documents first.
    """
    model = train(docs, text) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            keys, starts, ends = [], [], []
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b, unit in blocks(value):
                    if b <= a:
                        continue
                    for x, y in [(0, b - a)] if unit else tagger.cut(value[a:b]):
                        keys.append(key_)
                        starts.append(a + x)
                        ends.append(a + y)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    picked = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return picked.mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")
