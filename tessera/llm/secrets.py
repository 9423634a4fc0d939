"""Secret scans: base patterns, and values in a credential's context priced by the guesses it takes to find them.

The price is that of the cheapest way to write a value as words, dates, repeats, walks over the keyboard (or along the
alphabet and the digits) and spans of brute force, found by one dynamic program over the value's positions that offers
every such span.  "changeme2024" is a few thousand guesses, a generated key more than could be made; only values above
`THRESHOLD` are spans of the kind "guess".

Words are a short list of what stands in for passwords, and then the words of the corpus by the number of documents that
hold them, counted in Spark over all documents.  The scan is one pass over the texts; work is linear in the text and, but
for a few open starts of a run, in each value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, read, scratch, table

THRESHOLD, PENALTY = 15.0, math.log10(2)
#: Words of the corpus in the dictionary at most, their letters, and the documents that must hold one.
CORPUS_WORDS, LETTERS, IN_DOCUMENTS = 20_000, (3, 24), 5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer)["'\])]{0,2}[ \t]*(?:[:=]>?|\bis\b)[ \t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""",
    re.ASCII | re.IGNORECASE,
)
#: Every text with a span of any kind has one of these.
CANDIDATE = "(?i)pass|pwd|secret|token|key|auth|credential|bearer|akia|[0-9a-f]{32}"
#: Common words of passwords and of what stands in for them, the likeliest first.
WORDS = (
    "password pass admin root user login secret token key welcome master test guest changeme change default letmein dragon monkey "
    "shadow sunshine princess football baseball iloveyou love hello freedom whatever trustno superman batman hunter ranger summer "
    "winter spring autumn january february march april june july august september october november december monday friday example "
    "sample demo dummy placeholder your here insert value string none null true false required optional private public server "
    "database system manager super computer internet service account access code qwerty secure temp temporary my the is for "
    "replace me with redacted credential credentials process env environ environment config settings variable todo fixme enter "
    "add real example.com localhost undefined empty hidden masked removed xxx"
).split()
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SPOTS = {c: (x + y / 2, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


class Ranks:
    """Words by rank, from 1; those given first keep theirs."""

    def __init__(self, *lists: list[str]):
        self.rank: dict[str, int] = {}
        for words in lists:
            for w in words:
                self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


BASE = Ranks(WORDS)


def _step(a: str, b: str) -> str:
    """The kind of step from one character to the next: along the keyboard, or up or down in code."""
    if abs(ord(a) - ord(b)) == 1 and (a + b).isalnum():
        return "up" if a < b else "down"
    p, q = SPOTS.get(a.lower()), SPOTS.get(b.lower())
    if p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return f"{q[0] - p[0]:+}{q[1] - p[1]:+}"
    return ""


def _cardinality(value: str) -> int:
    classes = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[!-/:-@\[-`{-~]", 32), (r"[^!-~]", 100))
    return sum(n for c, n in classes if re.search(c, value))


def brute_cost(value: str) -> float:
    """log10 of the guesses for each character of a span of brute force."""
    return math.log10(max(_cardinality(value), 10))


def _plain(value: str) -> tuple[str, str]:
    """The value in lower case, and with leet undone, character by character."""
    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return lower, lower.translate(LEET)


def word_cost(own: str, lower: str, plain: str, rank: int) -> float:
    """log10 of the guesses for a word: its rank, its capitals and its replaced letters."""
    upper, size = sum(c.isupper() for c in own), len(own)
    cased = 0.0 if not upper else math.log10(2) if upper == size or own[0].isupper() and upper == 1 else math.log10(math.comb(size, upper) + 1)
    return math.log10(rank + 1) + cased + sum(a != b for a, b in zip(lower, plain)) * math.log10(2)


def date_cost(size: int) -> float:
    return math.log10(100 * (365 if size > 4 else 1))


def walk_cost(steps: int, turns: int) -> float:
    """log10 of the guesses for a walk: a start, a direction for each straight stretch, and its length."""
    return math.log10(94) + turns * TURN + math.log10(steps + 1)


def repeat_cost(unit: int, times: int, brute: float) -> float:
    return unit * brute + math.log10(times)


TURN, WALK, TIMES, UNITS = math.log10(5), 3, 3, 4


class _Starts:
    """Open starts of a run whose price is that of the start and the logarithm of the length: those that some other
    start beats at every later end are dropped, which leaves a handful however long the run."""

    def __init__(self, least: int):
        self.least, self.open = least, []

    def add(self, i: int, price: float) -> None:
        if all(price < p + math.log10((i + self.least - k) / self.least) for k, p in self.open):
            self.open = [(k, p) for k, p in self.open if p < price] + [(i, price)]

    def best(self, j: int) -> float:
        return min((p + math.log10(j - i) for i, p in self.open), default=math.inf)


def guesses(value: str, ranks: Ranks = BASE) -> float:
    """log10 of the guesses for a value: the least sum of costs over all its segmentations into words, dates, walks (three
    characters or more), repeats (a unit of one to four characters, three times or more) and characters of brute force;
    each span but those of brute force that does not begin the value costs log10(2) more."""
    n, brute = len(value), brute_cost(value)
    lower, plain = _plain(value)
    steps = ["", ""] + [_step(a, b) for a, b in zip(value, value[1:])]  # steps[j] leads to character j, from 1
    turns = [0] * (n + 1)
    for j in range(3, n + 1):
        turns[j] = turns[j - 1] + (steps[j] != steps[j - 1])
    best = [0.0] + [math.inf] * n
    walks, repeats, alike = _Starts(WALK), {u: [_Starts(TIMES * u) for _ in range(u)] for u in range(1, UNITS + 1)}, [0] * (UNITS + 1)
    for j in range(1, n + 1):
        found = best[j - 1] + brute
        entry = lambda i: best[i] + (PENALTY if i else 0.0)
        for size in range(2, min(ranks.longest, j) + 1):
            rank = ranks.rank.get(plain[j - size : j])
            if rank:
                found = min(found, entry(j - size) + word_cost(value[j - size : j], lower[j - size : j], plain[j - size : j], rank))
        for m in () if not value[j - 1].isdigit() else range(4, min(10, j) + 1):
            if DATE.fullmatch(value, j - m, j):
                found = min(found, entry(j - m) + date_cost(m))
        if not steps[j]:
            walks.open = []
        elif j >= WALK and steps[j - 1]:
            i = j - WALK
            walks.add(i, entry(i) + math.log10(94) + TURN * (1 - turns[i + 2]))
            found = min(found, walks.best(j) + TURN * turns[j])
        for u in range(1, UNITS + 1):
            alike[u] = alike[u] + 1 if j > u and value[j - 1] == value[j - 1 - u] else 0
            if not alike[u]:
                for own in repeats[u]:
                    own.open = []
            elif alike[u] >= (TIMES - 1) * u:
                i = j - TIMES * u
                own = repeats[u][i % u]
                own.add(i, entry(i) + u * brute - math.log10(u))
                found = min(found, own.best(j))
        best[j] = found
    return best[n]


def scan(text: str, threshold: float = THRESHOLD, ranks: Ranks = BASE) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, log10 of guesses) by start, then kind as listed: assign, access, hex, guess.

    Base spans are whole matches, end exclusive, in code points; a guess span is the value alone."""
    found = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        if (g := guesses(m[m.lastindex], ranks)) >= threshold:
            found.append((m.start(m.lastindex), 3, m.end(m.lastindex), g))
    return [(s, e, ("assign", "access", "hex", "guess")[k], g) for s, k, e, g in sorted(found, key=lambda x: x[:2])]


def corpus_words(documents: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The words of the corpus that most documents hold, at most `most` of them (a few hundred KB), the commonest first.

    How many words have each count tells which count the last of them has, so that the tasks send only words at or above
    it to the driver, and not `most` words each."""
    low, high = LETTERS
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{%d,}" % low), F.lit(0)))
    words = documents.select(F.explode(held).alias("word")).where(F.length("word") <= high).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    with scratch(documents.sparkSession):
        words = table(words.where(F.col("n") >= IN_DOCUMENTS))
        counts = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()
        total, least = 0, 0
        for r in counts:
            total, least = total + r["words"], r["n"]
            if total >= most:
                break
        return [r["word"] for r in words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def find_secrets(documents: DataFrame, threshold: float = THRESHOLD, most_words: int = CORPUS_WORDS) -> DataFrame:
    """doc_id and spans (kind, start, end, log10_guesses) of every row.

    Null and empty texts have none; repeated rows each get a row; an empty table gives an empty one; columns other than
    doc_id and text are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
    held = documents.sparkSession.sparkContext.broadcast(Ranks(WORDS, corpus_words(documents, most_words)))  # bounded by most_words

    def each(batch: pa.RecordBatch) -> Iterator[dict]:
        ranks = held.value
        spans = [[{"kind": k, "start": s, "end": e, "log10_guesses": g} for s, e, k, g in scan(text, threshold, ranks)] if (text := t.as_py()) else [] for t in batch.column(1)]
        yield {"doc_id": batch.column(0), "spans": pa.array(spans, kind)}

    # Texts in which nothing can be found stay in the JVM.
    text = F.when(F.col("text").rlike(CANDIDATE), F.col("text")).alias("text")
    return map_batches(documents.select(F.col("doc_id").cast("long"), text), each, "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("guess"))
