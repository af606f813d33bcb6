"""Operator 5: secret scan with assignment-aware lexing.

Three base patterns find assignments, access keys and long hexadecimal runs. The
method reads a text that holds ``=`` or ``:`` as source or configuration text:
a lexer yields names, operators and literals over the whole text, the parser turns
them into name-literal pairs; a type between name and ``=`` is passed over, and a value
may stand on the next line, in brackets or in triple quotes. What is called,
subscripted or a dotted name of letters is code, no literal. Then names bound to a
literal are propagated to names bound to those names, adjacent literals joined by
``+`` count as one, and a literal is scored by how sensitive its names are and how
random it looks. Spans are code points, end exclusive.

A NULL text is empty. Texts are read whole, whatever their length and however many
values stand inside one another. Bytes that are not UTF-8 are read as U+FFFD, one code
point each. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.byte_bpe import column_type
from newsflow.llm.tokens import sliced

KINDS = ("assign", "access", "hex", "literal", "constant")

_ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Runs are maximal, so asking for the least length drops exactly the short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{16}")
_LEAST_ASSIGNED = 12

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    found = [
        ("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST_ASSIGNED
    ]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


# Quotes are possessive, so an open one costs no second look at what follows it.
_TOKEN = re.compile(
    r"""(?P<triple>(?:(?<![A-Za-z0-9_])[rRbBuUfF]{1,2})?(?:\"{3}(?s:(?:(?!\"{3})[^\\]|\\.)*+)\"{3}|'{3}(?s:(?:(?!'{3})[^\\]|\\.)*+)'{3}))"""
    r"""|(?P<string>(?:(?<![A-Za-z0-9_])[rRbBuUfF]{1,2})?(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`))"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[=:+])"""
    r"""|(?P<word>[A-Za-z0-9_$@./~-]+(?:=+(?=[\s,;)\]}]|$))?)"""
    r"""|(?P<end>\n)"""
    r"""|(?P<other>[^\s])"""
)
# An unquoted value goes on to white space, a delimiter or the next parameter.
_STOP = re.compile(r"[\s,;\"'`()\[\]{}<>]|&(?=[A-Za-z_]\w*=)")
_OPENING = {"(", "[", "{"}
# Nothing is given back, so a type of any length is read once.
_TYPE = re.compile(
    r"\s*+[A-Za-z_][A-Za-z0-9_.]*+(?>\[[^\n=]*\]|<[^\n=]*>)?+"
    r"(?:\s*+[|?]\s*+[A-Za-z_][A-Za-z0-9_.]*+(?>\[[^\n=]*\])?+)*+\??+\s*+")
# An unquoted dotted name of letters, and anything called or subscripted, is code.
_DOTTED = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")
_NAME = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$@.-]*")
_DECLARES = {"export", "set", "let", "const", "var", "val", "final", "static", "public", "private", "env"}
_BINDS = {"=", ":", ":=", "=>"}

# How much a part of a name says that its value is secret.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "signature": 0.58, "salt": 0.58,
    "key": 0.58, "pin": 0.7, "session": 0.58, "cookie": 0.58,
}
_PLACEHOLDER = re.compile(
    r"(?i)example|changeme|placeholder|your[_-]|dummy|x{4,}|\*{3,}|^(?:true|false|null|none)$"
)
_LEAST_LITERAL = 4
_LEAST_OF_LETTERS = 8
_REPORT_FROM = 0.5


def sensitivity(name: str) -> float:
    """0 to 1: how much a target name says that its value is secret."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    parts = [p for p in re.split(r"[^a-z0-9]+", split) if p]
    joined = [*parts, *(a + b for a, b in zip(parts, parts[1:]))]
    return max((_SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1: character entropy against that of a random literal of the same length."""
    least = _LEAST_OF_LETTERS if literal.isalpha() else _LEAST_LITERAL
    if len(literal) < least or _PLACEHOLDER.search(literal) or any(c.isspace() for c in literal):
        return 0.0
    size = len(literal)
    bits = -sum(c / size * math.log2(c / size) for c in Counter(literal).values())
    return min(1.0, bits / min(math.log2(size), 4.0))


Token = tuple[str, str, int, int]


def tokens_of(text: str) -> list[Token]:
    """(kind, value, start, end) of the names, operators, literals and line ends of a text."""
    tokens = []
    for m in _TOKEN.finditer(text):
        kind, value, (start, end) = m.lastgroup, m[0], m.span()
        if kind in ("string", "triple"):
            prefix = len(value) - len(value.lstrip("rRbBuUfF"))
            quotes = 3 if kind == "triple" else 1
            start, end = start + prefix + quotes, end - quotes
            if kind == "triple":  # without the white space inside its quotes
                start += len(text[start:end]) - len(text[start:end].lstrip())
                end = start + len(text[start:end].rstrip())
            kind, value = "string", text[start:end]
        elif kind == "word" and value.endswith(":"):
            value, end = value[:-1], end - 1
        tokens.append((kind, value, start, end))
    return tokens


def _names_bound(text: str, tokens: list[Token]) -> dict[int, str]:
    """The name each operator binds. Where a type stands before ``=``, its colon binds nothing."""
    names: dict[int, str] = {}
    colon = None
    for i, (kind, value, start, end) in enumerate(tokens):
        if kind == "end":
            colon = None
        if kind != "op" or value not in _BINDS or i == 0:
            continue
        name, before = tokens[i - 1][1], tokens[i - 1][0]
        if value == "=" and colon in names and _TYPE.fullmatch(text, tokens[colon][3], start):
            names[i] = names.pop(colon)
        elif before in ("word", "string") and _NAME.fullmatch(name) and name not in _DECLARES:
            names[i] = name
        colon = i if value == ":" else None
    return names


def bindings(text: str) -> Iterator[tuple[str, list[Token]]]:
    """Names a text binds, each with the terms of its value: (kind, text, start, end).

    The text of an unquoted value that is no single word is left out, so values that
    begin inside one another cost no copies.
    """
    tokens = tokens_of(text)
    stops = [m.start() for m in _STOP.finditer(text)]
    for i, name in _names_bound(text, tokens).items():
        terms, j, brackets = [], i + 1, 0
        while j < len(tokens) and (tokens[j][0] == "end" or tokens[j][1] in _OPENING and tokens[j][0] == "other"):
            brackets += tokens[j][0] != "end"
            j += 1
        lines = any(t[0] == "end" for t in tokens[i + 1 : j])
        while j < len(tokens) and tokens[j][0] in ("word", "string", "other"):
            term = tokens[j]
            if term[0] != "string":
                at = bisect_left(stops, term[2])
                end = stops[at] if at < len(stops) else len(text)
                joined = j + 1 < len(tokens) and tokens[j + 1][1] == "+" and (
                    term[0] == "word" and (brackets or text[term[3] : term[3] + 1] != "+"))
                if end > term[3] and not joined:
                    if text[term[3]] in ":=" and term[0] == "word" and (lines or brackets):
                        break  # the next line or the bracket binds a name of its own
                    term = ("word", "", term[2], end)
                elif end <= term[2]:
                    break
                if text[term[3] : term[3] + 1] in ("(", "[") or _DOTTED.fullmatch(text, term[2], term[3]):
                    terms = []
                    break
            terms.append(term)
            # Tokens inside an unquoted value belong to it.
            j = bisect_left(tokens, term[3], j + 1, key=itemgetter(2))
            k = j
            while k < len(tokens) and tokens[k][0] == "end":
                k += 1
            if k < len(tokens) and tokens[k][1] == "+":
                j = k + 1
                while j < len(tokens) and tokens[j][0] == "end":
                    j += 1
            elif brackets and term[0] == "string" and k < len(tokens) and tokens[k][0] == "string":
                j = k  # literals side by side in brackets are one
            else:
                # After a line end or a bracket, what stands before = or : is a name, not a value,
                # and a bare word of letters is prose or code.
                names_next = k == j and k < len(tokens) and tokens[k][0] == "op" and tokens[k][1] in _BINDS
                letters = term[0] == "word" and text[term[2] : term[3]].isalpha()
                if (lines or brackets) and (names_next or letters):
                    terms = []
                break
        if terms:
            yield name, terms


@dataclass
class Constant:
    """A literal of the text, or one put together from several; its score is found once."""

    text: str
    start: int
    end: int
    joined: str | None = None
    score: float | None = None

    @property
    def literal(self) -> str:
        return self.text[self.start : self.end] if self.joined is None else self.joined

    def randomness(self) -> float:
        if self.score is None:
            self.score = randomness(self.literal)
        return self.score


def _score_suffixes(values: list[Constant]) -> None:
    """Scores of unquoted values that end at one place, each character counted once.

    The longer ones begin with the shorter ones' outer names, so they are taken from
    the right, and the entropy of each follows from the counts so far.
    """
    text, end = values[0].text, values[0].end
    values = sorted(values, key=lambda v: -v.start)
    whole = text[values[-1].start : end]
    marked = [m.start() for m in re.finditer(f"(?={_PLACEHOLDER.pattern.replace('(?i)', '')})", whole, re.I)]
    last_mark = values[-1].start + marked[-1] if marked else -1
    counts: Counter[str] = Counter()
    total, at = 0.0, end
    for value in values:
        for char in text[value.start : at]:
            n = counts[char]
            counts[char] = n + 1
            total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
        at, size = value.start, end - value.start
        if size <= 64:
            value.randomness()
        elif last_mark >= value.start:
            value.score = 0.0
        else:
            value.score = min(1.0, (math.log2(size) - total / size) / 4.0)


def lexed_spans(text: str) -> list[Span]:
    """Literals whose names, directly or through other names, are sensitive.

    A value put together that is longer than its whole text is no constant.
    """
    constants: dict[str, Constant] = {}
    named: list[tuple[str, float, Constant]] = []
    for name, terms in bindings(text):
        kind, value, start, end = terms[0]
        if len(terms) == 1 and kind == "word" and value in constants:
            constant, how = constants[value], "constant"
        elif len(terms) == 1:
            constant, how = Constant(text, start, end), "literal"
        else:
            parts = [
                constants[t[1]] if t[0] == "word" and t[1] in constants else Constant(text, t[2], t[3]) for t in terms
            ]
            long = sum(p.end - p.start if p.joined is None else len(p.joined) for p in parts) > len(text)
            constant = Constant(text, start, terms[-1][3], None if long else "".join(p.literal for p in parts))
            how = "literal"
        constants[name] = constant
        weight = sensitivity(name)
        if weight:
            named.append((how, weight, constant))
    # Only unquoted values end where others do.
    ends: dict[int, dict[int, Constant]] = {}
    for _, _, constant in named:
        if constant.joined is None:
            ends.setdefault(constant.end, {})[id(constant)] = constant
    for own in ends.values():
        if len(own) > 1:
            _score_suffixes(list(own.values()))
    return list({
        (how, constant.start, constant.end): None
        for how, weight, constant in named if weight * constant.randomness() >= _REPORT_FROM
    })


def in_order(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed."""
    spans = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_RESULT = (
    "n_assign long, n_access long, n_hex long, n_literal long, n_constant long,"
    " base_sha256 string, spans string"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", *(part.split()[0] for part in _RESULT.split(","))]
    for batch, rows in sliced(batches, "text"):
        counts, digests, spans = [], [], []
        for i in range(len(rows)):
            raw = rows.raw(i)
            base, more = [], []
            binds = b"=" in raw or b":" in raw
            if binds or b"AKIA" in raw or _HEX_BYTES.search(raw):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                more = lexed_spans(text) if binds else []
            of = Counter(kind for kind, _, _ in (*base, *more))
            counts.append([of[kind] for kind in KINDS])
            digests.append(hashlib.sha256(in_order(base).encode()).hexdigest())
            spans.append(in_order(base + more))
        columns = [pa.array(list(c), pa.int64()) for c in zip(*counts)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *columns, pa.array(digests), pa.array(spans)], names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans of every document."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {column_type(docs, id_col)}, {_RESULT}"
    return texts.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)
