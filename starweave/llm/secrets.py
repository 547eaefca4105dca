"""Secrets in text: fixed patterns, and strings a tokenizer cannot shorten.

A byte-pair vocabulary packs language into few tokens.  A string with few
characters for each token is random; what is known to look random without
being secret (digests, UUIDs, numbers) is left out first.
"""

from __future__ import annotations

import base64
import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from starweave.llm.common import free_name

#: Ranks of the byte-pair vocabulary, and the pattern that splits text before its merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a candidate at least, and characters for each token below which it counts as random.
LEAST, RATIO = 20, 2.2
REDACTED = "[SECRET]"

KINDS = ("assign", "access", "hex", "random")
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())])

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_NAMED = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates are parted by all else, by ':', '.', '@' and '%' too.
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_PART = re.compile(rf"[A-Za-z0-9+_=-]{{{LEAST},}}")
_LETTER = re.compile(r"[A-Za-z]")
#: What looks random and is known: digests by length, UUIDs, hexadecimal numbers.  Names are left to the ratio.
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_KNOWN = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|0x[0-9a-f]+", re.IGNORECASE)


class Scanner(NamedTuple):
    ranks: dict[bytes, int]
    ratio: float

    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})


def scanner(vocabulary: str = VOCABULARY, ratio: float = RATIO) -> Scanner:
    """Read the ranks on the driver; the tasks get them with the function, some hundred KB."""
    with open(vocabulary, "rb") as lines:
        return Scanner({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, ratio)


def is_digest(text: str) -> bool:
    return len(text) in _DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None


def is_random(word: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """Few characters for each token, and not known; a string without a letter is a number."""
    if not _LETTER.search(word) or _KNOWN.fullmatch(word) or is_digest(word):
        return False
    return len(word) < ratio * len(encoding.encode_ordinary(word))


def random_spans(text: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """Spans of strings with few characters for each token, known ones left out.

    A string with slashes that is not random as a whole is looked at part by
    part: base64 has slashes within, a path has them around.
    """
    found = []
    for m in _CANDIDATE.finditer(text):
        if is_random(m.group(), encoding, ratio):
            found.append(m.span())
        elif "/" in m.group():
            found += [p.span() for p in _PART.finditer(text, *m.span()) if is_random(p.group(), encoding, ratio)]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    if _NAMED.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def spans(text: str, encoding: tiktoken.Encoding, ratio: float) -> list[tuple[str, int, int]]:
    """All spans by start, then kind.  A random string that a base span holds whole is not named again.

    Both lists go by start, so one pass over them tells: of the base spans
    that start no later, the one that reaches furthest holds it or none does.
    """
    base = sorted(base_spans(text), key=lambda s: s[1])
    found, at, reach = list(base), 0, 0
    for a, b in random_spans(text, encoding, ratio):
        while at < len(base) and base[at][1] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if reach < b:
            found.append(("random", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Texts without a character run or word that a span needs are not looked at one by one.
_WORTH = r"[A-Za-z0-9+/_=-]{20}|AKIA[A-Z0-9]{12}|(?i:passw|secret|token|api_?key)"


def _found(column: pa.Array, own: Scanner, encoding: tiktoken.Encoding) -> list[list[tuple[str, int, int]]]:
    column = column.fill_null("")
    worth = pc.match_substring_regex(column, _WORTH).to_pylist()
    return [spans(column[i].as_py(), encoding, own.ratio) if w else [] for i, w in enumerate(worth)]


def scan(docs: DataFrame, text_col: str = "text", own: Scanner | None = None, name: str | None = None) -> DataFrame:
    """``docs`` with a list of ``kind, start, stop`` for each text, in code points, stop exclusive.

    Kinds are ``assign``, ``access`` and ``hex`` (fixed patterns) and
    ``random`` (token efficiency).  Null texts are empty and have none.  Each
    row is looked at on its own, repeated rows too; nothing is shuffled.  The
    list is the last column, ``spans`` or ``name``; if ``docs`` has a column
    of that name, which stays, a suffix is added.
    """
    own = own or scanner()
    name = free_name(docs, name or "spans")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        encoding = own.encoding()
        for batch in batches:
            rows = [[{"kind": k, "start": a, "stop": b} for k, a, b in row] for row in _found(batch.column(at), own, encoding)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def redact_text(text: str, found: list[tuple[str, int, int]], mark: str = REDACTED) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, upto = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(found, key=lambda s: s[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[upto:a], mark]
        upto = b
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", own: Scanner | None = None) -> DataFrame:
    """``docs`` with secrets replaced by a mark and the length column counted anew; columns unchanged.

    Rows without a secret, null and empty texts stay as they are.  All rows
    stay, repeated ones and those without id too; no column is added.
    """
    own = own or scanner()
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        encoding = own.encoding()
        for batch in batches:
            found = _found(batch.column(at), own, encoding)
            columns = list(batch.columns)
            hit = [i for i, f in enumerate(found) if f]
            if hit:
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = redact_text(texts[i], found[i])
                columns[at] = pa.array(texts, columns[at].type)
                if length is not None:
                    sizes = columns[length].to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(found, kinds: tuple[str, ...] | None = None):
    """``kind:start:stop`` of the spans, comma-joined."""
    if kinds:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(found, kind: str):
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

