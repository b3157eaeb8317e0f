"""Personal data: fixed patterns, and identifiers found by bootstrapped context patterns.

Base spans are those of four fixed patterns (email, ip, card, phone). They are the seeds of the bootstrap,
with one more kind that texts hold, `secret`: a token of SECRET_CHARS or more letters and digits mixed.

1. Instances are stretches of text: each base span as a whole, each run of tokens of digits and their
   punctuation, and each other token that has a digit or @; of MIN_CHARS characters at least. The one or
   two words before an instance, outside of it, with its shape (letters a, digits 9, longer runs cut), or
   the two words with any shape, make its lexical patterns; they are counted with map-side combine. One
   word with any shape is none: it would take a date after "a" for an address.
2. Patterns and instances score each other in turn, in Spark: a pattern by the share of its occurrences
   whose instance is believed, an instance by the best pattern it occurs in, and what an instance is
   believed to be counts in all its patterns. So each round can admit patterns without any seed. All
   patterns with support are in the graph whose words meet them often enough: against all occurrences of
   the words in the corpus, whatever follows, an instance of the pattern follows in RATE of them at least.
   So words that stand before anything are no evidence. A pattern needs two different believed instances.
3. Patterns above CONFIDENCE mark those of their instances that no base span covers; seeds of kind
   `secret` are marked wherever they stand.

Defined cases: null and empty texts have no spans; spans are code points, end exclusive; base spans stay
as they are and an added span never overlaps one; a tie between kinds goes to the one that comes last in
the alphabet; each row is judged by itself, repeated rows get equal results; patterns are learnt from all
rows; an empty table gives an empty one; ids may be of any type that Spark can cast to string. Words that are
named by their shape or kind (numbers, base spans, over 60 characters) have no count in the corpus, so
patterns with them are held against their own occurrences only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed, small_batches, stored, text_key

KINDS = ("email", "ip", "card", "phone")
MIN_CHARS = 7
#: Characters of a token that is a secret by its look.
SECRET_CHARS = 20
#: Occurrences that a pattern needs, and its score.
SUPPORT, CONFIDENCE = 5, 0.5
ROUNDS = 3
#: Of the occurrences of a pattern's words, the share that an instance of the pattern follows.
RATE = 0.1
#: Different believed instances that a pattern needs.
DIFFERENT = 2
#: Patterns that are sent to every task; more are joined.
SENT = 50_000
#: Patterns' words that are broadcast to the texts to count them; of more, Spark joins as it sees fit.
SENT_WORDS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# no match of these starts inside a run of digits unless one starts at its beginning
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NUMERIC = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*[,;:!?]*\Z")
_SECRET = re.compile(r"(?=[A-Za-z0-9_+/=-]*[A-Za-z])(?=(?:[A-Za-z_+/=-]*[0-9]){4})[A-Za-z0-9_+/=-]+\Z")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it, back to the end of the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            n = len(digits := m[0].replace(" ", "").replace("-", ""))
            if 12 <= n <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _named(word: str) -> str:
    """The word, or a name for one of over 60 characters."""
    return word if len(word) <= 60 else "#" + hashlib.blake2b(word.encode(), digest_size=8).hexdigest()


def shape(token: str) -> str:
    """Letters to a, digits to 9, others as they are; runs of over three of one kind are cut to three and a plus."""
    out = re.sub("[0-9]", "9", token)
    out = re.sub(r"[^\W\d_]", "a", out)
    return _named(re.sub(r"a{4,}", "aaa+", re.sub(r"9{4,}", "999+", out)))


def _units(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, kind) of what stands between white space: base spans whole (overlapping ones: the first), runs of numeric tokens as one, other tokens one by one."""
    spans = sorted((a, b, k) for k, a, b in spans)
    at, done = 0, 0  # done: the end of the base span given last
    run: tuple[int, int] | None = None
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while at < len(spans) and (spans[at][1] <= start or spans[at][0] < done):
            at += 1
        if at < len(spans) and spans[at][0] < end:
            if run:
                yield *run, None
                run = None
            yield spans[at]
            done = spans[at][1]
        elif start < done:
            continue
        elif _NUMERIC.match(m[0]):
            run = (run[0], end) if run and start == run[1] + 1 else run or (start, end)
            if run[1] != end:
                yield *run, None
                run = (start, end)
            if m[0][-1] in ",;:!?":
                yield *run, None
                run = None
        else:
            if run:
                yield *run, None
                run = None
            yield start, end, None
    if run:
        yield *run, None


def candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(start, end, context, shape, kind of the base span that it is, if any) of what looks like an identifier."""
    if not _DIGIT.search(text) and "@" not in text:
        return
    before = ["", ""]
    for start, end, kind in _units(text, spans):
        raw = text[start:end]
        has = _DIGIT.search(raw) is not None
        if kind:
            yield start, end, " ".join(before).strip().lower(), shape(raw), kind
            before = [before[1], f"<{kind}>"]
            continue
        if has or "@" in raw:
            token = raw.strip(_EDGE) if raw[0] != "(" or ")" not in raw[:-1] else raw.rstrip(_EDGE)
            if len(token) >= MIN_CHARS:
                at = start + raw.index(token)
                yield at, at + len(token), " ".join(before).strip().lower(), shape(token), None
        before = [before[1], shape(raw) if has else _named(raw)]


def is_secret(token: str) -> bool:
    return len(token) >= SECRET_CHARS and _SECRET.match(token) is not None


def _patterns(context: str, form: str) -> list[str]:
    """The patterns that a token occurs in, the most specific first: the context's last two words with the shape or with any (*), then the last word with the shape."""
    words = context.split(" ")
    return [" ".join(words[-d:]) + " _ " + f for d in (2, 1) if len(words) >= d and words[-1] for f in ((form, "*") if d == 2 else (form,))]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, instance, kind, n): the instance is a hash of the token. A pattern of null counts the token itself, so that seeds without context are known."""
    for batch in batches:
        count: Counter = Counter()
        for text in batch.column(0):
            text = text.as_py()
            for start, end, context, form, kind in candidates(text, base_spans(text)):
                token = hashlib.blake2b(text[start:end].lower().encode(), digest_size=12).hexdigest()
                kind = kind or ("secret" if is_secret(text[start:end]) else None)
                for pattern in (None, *_patterns(context, form)) if kind else _patterns(context, form):
                    count[(pattern, token, kind or "")] += 1
        rows = list(count.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.string()) for i in range(3)] + [pa.array([n for _, n in rows], pa.int64())], names=["pattern", "instance", "kind", "n"])


def _word_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(words, often): how often each of the wanted words or pairs of words stands anywhere, lower-cased."""
    if wanted.count() <= SENT_WORDS:
        wanted = F.broadcast(wanted)
    split = texts.select(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat_ws(" ", F.get("t", i), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    return split.select(F.explode(F.concat("t", pairs)).alias("words")).join(wanted, "words", "left_semi").groupBy("words").agg(F.count("*").alias("often"))


def learn_patterns(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, rate: float = RATE) -> DataFrame:
    """(pattern, kind, score) of the patterns above `confidence`, of at least `support` occurrences.

    The graph's edges are (pattern, instance) with counts. Patterns without support, or whose words mostly
    stand before something else, are left out at once; whether a pattern has seeds of its own doesn't matter.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = texts.mapInArrow(_occurrences, "pattern string, instance string, kind string, n long")
    counted = stored(seen.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n")))
    by_kind = counted.where("pattern is null").groupBy("instance", "kind").agg(F.sum("n").alias("n"))
    # a seed is of one kind everywhere, and stays so
    seeds = stored(by_kind.groupBy("instance").agg(F.max(F.struct("n", "kind")).alias("m")).select("instance", F.col("m.kind").alias("kind"), F.lit(1.0).alias("belief")))
    edges = counted.where("pattern is not null").groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    supported = stored(edges.groupBy("pattern").agg(F.sum("n").alias("total")).where(F.col("total") >= support).withColumn("words", F.substring_index("pattern", " _ ", 1)))
    often = _word_counts(texts, stored(supported.select("words").distinct()))
    frequent = supported.join(often, "words", "left").where(F.col("total") >= rate * F.greatest(F.col("total"), "often")).select("pattern", "total")
    graph = stored(edges.join(frequent, "pattern"))
    others = stored(graph.join(seeds, "instance", "left_anti").select("pattern", "instance"))

    def strong(beliefs: DataFrame) -> DataFrame:
        scored = graph.join(beliefs, "instance").groupBy("pattern", "kind").agg((F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("score"), F.count("*").alias("different"))
        return scored.where((F.col("score") >= confidence) & (F.col("different") >= DIFFERENT)).drop("different")

    beliefs = seeds
    for _ in range(rounds):
        # an instance that is no seed is believed as far as its best pattern
        lifted = others.join(strong(beliefs), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        beliefs = seeds.unionByName(stored(lifted))
    return strong(beliefs).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("m")).select("pattern", "m.kind", "m.score")


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.get(s[0], len(order)), s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans gives way to the kind of its first, in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _match(known: dict[str, str], context: str, form: str) -> str | None:
    """The kind of the most specific known pattern here."""
    return next((k for p in _patterns(context, form) if (k := known.get(p))), None)


def _extract(known: dict[str, str] | None):
    """known: the patterns, or None if each text comes with those that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, learnt in zip(batch.column("text"), batch.column("patterns"), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                here = known if known is not None else {p["pattern"]: p["kind"] for p in learnt.as_py() or ()}
                added = []
                for start, end, context, form, kind in candidates(text, base):
                    if kind is None and (hit := "secret" if is_secret(text[start:end]) else _match(here, context, form)):
                        added.append((hit, start, end))
                count = Counter(k for k, _, _ in base)
                found = spans_text(base)
                rows.append((*[count[k] for k in KINDS], len(base) + len(added), hashlib.sha256(found.encode()).hexdigest(), spans_text(base + added) if added else found, redact(text, base + added) if base or added else text))
            names = [f"n_{k}" for k in KINDS] + ["n_spans", "base_sha256", "spans", "redacted"]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("kept"), *[pa.array([r[i] for r in rows], kinds[i]) for i in range(8)]], names=["kept", *names])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, pattern) of tokens that no base span covers."""
    for batch in batches:
        rows = set()
        for i, k, text in zip(*(batch.column(c) for c in ("id", "k", "text")), strict=True):
            text = text.as_py() or ""
            for _, _, context, form, kind in candidates(text, base_spans(text)):
                if kind is None:
                    rows |= {(i.as_py(), k.as_py(), p) for p in _patterns(context, form)}
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["id", "k", "pattern"])


def extract(docs: DataFrame, patterns: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True, sent: int = SENT) -> DataFrame:
    """One row per row of docs: kept (a struct of the columns in keep and the id), n_email, n_ip, n_card, n_phone, n_spans (base and added), base_sha256, spans, redacted.

    patterns: from learn_patterns; learnt from docs if not given. Up to `sent` patterns go to the tasks
    with the code; more are joined to the texts that may hold them.
    """
    small_batches(docs.sparkSession)
    patterns = learn_patterns(docs, text_col) if patterns is None else patterns
    patterns = checkpointed(patterns.select("pattern", "kind"))
    kept = F.struct(*dict.fromkeys((*keep, id_col))).alias("kept")
    if patterns.count() <= sent:
        known = {r["pattern"]: r["kind"] for r in patterns.collect()}  # at most `sent` rows
        rows = docs.select(kept, F.col(text_col).alias("text"), F.lit(None).cast("array<struct<pattern:string,kind:string>>").alias("patterns"))
    else:
        known = None
        texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(text_key(text_col), F.lit(0)).alias("k"), F.col(text_col).alias("text"))
        held = texts.mapInArrow(_asked, "id string, k long, pattern string").join(patterns, "pattern").groupBy("id", "k").agg(F.collect_set(F.struct("pattern", "kind")).alias("patterns")).alias("h")
        full = docs.select(kept, F.col(text_col).alias("text"), F.coalesce(text_key(text_col), F.lit(0)).alias("k")).alias("d")
        joined = full.join(held, F.col(f"d.kept.{id_col}").cast("string").eqNullSafe(F.col("h.id")) & (F.col("d.k") == F.col("h.k")), "left")
        rows = joined.select("d.kept", "d.text", "h.patterns")
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string, redacted string"
    out = rows.mapInArrow(_extract(known), schema)
    return out if with_text else out.drop("redacted")
