"""Secrets in texts: fixed patterns, and literals assigned to names that sound secret.

The lexer reads source and configuration syntax as pairs of a name and an
expression of literals and other names.  Names that are assigned to a sensitive
name become sensitive themselves, so a literal is found where it stands even if it
reaches the password over several constants.  A literal counts when the score of its
target's name times the score of its own shape is high enough.  Strings may go over lines,
and of "Bearer", "Basic" or "Token" and one term, the term is the literal.
"""

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import plain, table

# The base patterns of the contract.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "named")

# Parts of names that make a target sensitive, alone or in pairs, and parts that say it holds no secret.
SENSITIVE = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "bearer", "authorization"}
SENSITIVE_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("connection", "string")}
HARMLESS = {"count", "length", "len", "size", "max", "min", "limit", "type", "name", "path", "file", "url", "field", "label", "expiry", "expires", "ttl", "policy", "hint", "id", "regex", "pattern", "header", "prompt"}
EMPTY_WORDS = {"none", "null", "nil", "true", "false", "undefined", "string", "changeme", "example", "placeholder", "redacted", "required", "optional"}

#: Without one of these no name in a text is sensitive.
TELLING = sorted(SENSITIVE | {second for _, second in SENSITIVE_PAIRS})

OPERATOR = re.compile(r"=>|:=|<-|=(?![=>])|:(?![:/=])")
#: A quoted term.  Simple quotes may go over lines if what closes them does not open a word.
QUOTED = re.compile(
    r"""[ \t]*[rbuRBU]{0,2}(?:(?P<three>"{3}|'{3})(?P<long>(?:\\.|(?!(?P=three))[^\\])*+)(?P=three)"""
    r"""|(?P<quote>["'`])(?:(?P<text>(?:\\[^\n]|(?!(?P=quote))[^\\\n])*+)(?P=quote)|(?P<lines>(?:\\.|(?!(?P=quote))[^\\])*+)(?P=quote)(?!\w)))""",
    re.DOTALL,
)
BARE = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>+]+)""")
#: An authentication scheme is no secret; the one term or template behind it is taken, in which a plus does not join anything.
SCHEME = re.compile(r"(?ai:bearer|basic|token)")
BEHIND = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>+][^\s"'`,;#(){}\[\]<>]*)""")
WITH_SCHEME = re.compile(rf"\s*{SCHEME.pattern}(?:\s+(?P<term>\S+|[<$%{{].*\S))?\s*", re.DOTALL)
#: Behind a colon, the lines that are indented more than the name.
BLOCK = re.compile(r"[ \t]*[|>][-+0-9]*[ \t]*\r?\n")
PLUS = re.compile(r"[ \t]*\+")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*)\}?$")
#: A literal counts from this product of its two scores on.
THRESHOLD = 0.5


def name_score(name: str) -> float:
    """How surely a value under this name is a secret."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    if not any(p in SENSITIVE for p in parts) and not any(pair in SENSITIVE_PAIRS for pair in zip(parts, parts[1:], strict=False)):
        return 0.0
    return 0.3 if parts[-1] in HARMLESS else 1.0


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret value rather than a word, a blank to fill or a template.  Blanks in it do not count."""
    words = value.split()
    shown = "".join(words)
    if len(value.strip()) < 6 or all(w.lower() in EMPTY_WORDS for w in words) or shown[0] in "<$%{" or len(set(shown)) < 4:
        return 0.0
    kinds = sum(any(test(c) for c in shown) for test in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum()))
    bits = -sum(n / len(shown) * math.log2(n / len(shown)) for n in Counter(shown).values())
    if kinds == 1:  # plain words: only where they are quoted, and not certain then
        return 0.5 if quoted else 0.0
    return min(1.0, bits / 2.5)


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start of the value, end of the value) of the three fixed kinds."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends before an operator, past blanks, one closing bracket and one closing quote, and where it begins."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] == "]":
        at -= 1
    if at and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start and (text[start - 1].isalnum() or text[start - 1] in "_$.-"):
        start -= 1
    name = text[start:at].lstrip("-$.")
    return name.rstrip("-$."), at - len(name)


def _block(text: str, name_at: int, at: int) -> tuple[int, int]:
    """(start, end) of the lines from ``at`` on that are empty or indented more than the name, without blanks around them."""
    column = name_at - (text.rfind("\n", 0, name_at) + 1)
    end = at
    while end < len(text):
        stop = text.find("\n", end) + 1 or len(text)
        line = text[end:stop]
        if line.strip() and len(line) - len(line.lstrip(" \t")) <= column:
            break
        end = stop
    inside = text[at:end]
    start = at + len(inside) - len(inside.lstrip())
    return start, max(start, at + len(inside.rstrip()))


def _operators(text: str) -> list[tuple[int, int, str, str]]:
    """(start of the name, end of the operator, operator, name) of all operators behind a name, in order."""
    out = []
    for m in OPERATOR.finditer(text):
        name, before = _name_before(text, m.start())
        if name and (name[0].isalpha() or name[0] == "_"):
            out.append((before, m.end(), m[0], name))
    return out


def _term(text: str, at: int, bare: re.Pattern, bound: int) -> tuple[int, int, int, bool] | None:
    """(end of the term, start and end of what is in it, quoted); a bare one ends before ``bound``."""
    if m := QUOTED.match(text, at):
        return m.end(), *next(m.span(k) for k in ("long", "text", "lines") if m[k] is not None), True
    if m := bare.match(text, at, bound):
        return m.end(), *m.span(1), False
    return None


def pairs(text: str):
    """(name, literals, references) of each assignment; a literal is (start, end, quoted).

    A bare term goes to the next blank, quote or bracket, but ends before an assignment inside it whose name is sensitive or
    follows "&"; other operators inside a bare term belong to it.  A bare term before "(" is a call and no literal.
    Each term is read once, so the work is proportional to the text.
    """
    operators, scores = _operators(text), {}
    for name in {o[3] for o in operators}:
        scores[name] = name_score(name)
    cuts = [o[0] for o in operators if scores[o[3]] > 0 or text[o[0] - 1 : o[0]] == "&"]
    cutting, consumed, read = set(cuts), 0, set()
    for name_at, after, operator, name in operators:
        if after < consumed and name_at not in cutting:
            continue
        if operator == ":" and (block := BLOCK.match(text, after)):
            yield name, [(*_block(text, name_at, block.end()), True)], []
            continue
        literals, references, at = [], [], after
        while at not in read:
            read.add(at)
            next_cut = bisect_right(cuts, at)
            bound = cuts[next_cut] if next_cut < len(cuts) else len(text)
            term = _term(text, at, BARE, bound)
            if term and not term[3] and SCHEME.fullmatch(text, term[1], term[2]):
                term = _term(text, term[0], BEHIND, bound)
            if not term:
                break
            at, start, end, quoted = term
            if quoted:
                scheme = WITH_SCHEME.fullmatch(text, start, end)
                if not scheme:
                    literals.append((start, end, True))
                elif scheme["term"]:
                    literals.append((*scheme.span("term"), True))
            else:
                consumed = max(consumed, end)
                if text[end : end + 1] == "(":  # a call
                    break
                if end == bound:
                    end = start + len(text[start:end].rstrip("&?"))
                if end > start:
                    if bare := REFERENCE.match(text, start, end):
                        references.append(bare[1])
                    literals.append((start, end, False))
                if consumed == bound:
                    break
            plus = PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if literals or references:
            yield name, literals, references


def named_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals under sensitive names, constants propagated."""
    if "=" not in text and ":" not in text and "<-" not in text:
        return []
    lower = text.lower()
    if not any(part in lower for part in TELLING):
        return []
    read = list(pairs(text))
    scores: dict[str, float] = {}
    sources: dict[str, set[str]] = {}
    assigned = {name for name, _, _ in read}
    for name, _, references in read:
        scores[name] = max(scores.get(name, 0.0), name_score(name))
        sources.setdefault(name, set()).update(r for r in references if r in assigned and r != name)
    queue = deque(n for n, s in scores.items() if s > 0)
    while queue:
        name = queue.popleft()
        for source in sources.get(name, ()):
            if scores[source] < scores[name]:
                scores[source] = scores[name]
                queue.append(source)
    found = []
    for name, literals, _ in read:
        if scores[name] > 0:
            for start, end, quoted in literals:
                if not quoted and text[start:end] in assigned:
                    continue
                score = scores[name] * literal_score(text[start:end], quoted)
                if score >= THRESHOLD:
                    found.append((start, end, name, score))
    return found


def spans_of(text: str) -> list[dict]:
    """All spans in order of start, then kind.  A literal is left out only if the value of one base span, or one other literal, contains all of it."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "value_start": c, "value_end": d, "name": None, "score": 1.0} for a, b, k, c, d in base]
    values = sorted((c, d) for _, _, _, c, d in base)
    starts = [c for c, _ in values]
    furthest = list(accumulate((d for _, d in values), max))  # the last end of the values up to each one
    last = 0
    for a, b, name, score in sorted(named_spans(text), key=lambda s: (s[0], -s[1])):
        before = bisect_right(starts, a)
        if b > last and not (before and furthest[before - 1] >= b):
            out.append({"kind": "named", "start": a, "end": b, "value_start": a, "value_end": b, "name": name, "score": score})
            last = b
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
_SPAN_SQL = "array<struct<kind: string, start: bigint, end: bigint, value_start: bigint, value_end: bigint, name: string, score: double>>"


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of every row, one narrow pass over whole texts.

    Positions are code points, the end exclusive.  Null and empty texts have no spans; null ids and repeated rows each keep
    their row.  Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            found = pa.array([spans_of(t) for t in plain(batch.column(1)).to_pylist()], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "spans"])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(scan, f"id {kind}, spans {_SPAN_SQL}").withColumnRenamed("id", id_column)


def redact(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns, every secret value in the text replaced by ``mark`` and the length column brought up to date.

    Null texts stay null.  Values that overlap are replaced by one mark, which stands for all that any of them covers.
    """

    def clean(text: str) -> str:
        spans = sorted((s["value_start"], s["value_end"]) for s in spans_of(text))
        if not spans:
            return text
        out, at = [], 0
        for start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def rewrite(batches):
        for batch in batches:
            names = batch.schema.names
            k = names.index(text_column)
            texts = [None if t is None else clean(t) for t in batch.column(k).to_pylist()]
            columns = list(batch.columns)
            columns[k] = pa.array(texts, pa.string())
            if length_column in names:
                n = names.index(length_column)
                old = batch.column(n)
                columns[n] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(rewrite, docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as counts, a digest of the base spans and the list of all spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(join(F.filter("spans", lambda s: s["kind"] != "named")), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"),
    )
