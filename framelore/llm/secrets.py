"""Secrets in texts: patterns, and strings that a tokenizer's vocabulary can hardly shorten.

A byte-pair vocabulary gives text one token for several characters, and random strings one for hardly two.  Runs of the
characters that keys are made of are put through the tokenizer; a run with few characters per token is reported unless it is
a digest or an identifier of a known form.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY, MOST_BYTES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 1 << 24
#: A run of so many characters or more is tested; so few characters per token are random.
LEAST, RATIO = 16, 1.9
KINDS = ("assign", "access", "hex", "random")
#: Spans of a text, sorted by start, then kind in the order of KINDS; places count code points, the end is exclusive.
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The patterns of the base and how long what they find has to be; how the vocabulary's tokenizer splits text.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 as hexadecimal digits.
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
KNOWN = re.compile(
    "|".join(
        [
            *(rf"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_DIGITS),  # a digest
            r"sha(?:1|224|256|384|512)[-=_/].*",  # a digest with its algorithm's name
            r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # a UUID
            r"[0-9+/_=-]+",  # numbers, dates, telephone numbers, rules
            r"[A-Za-z]?[a-z]{1,30}|[A-Z]{1,31}",  # words: fewer than 32 letters in one case
            r"[+/_=-]*[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)+[+/_=-]*",  # letters joined by marks: names, paths
            r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)+[0-9]{0,4}",  # camel case, perhaps numbered
        ]
    )
)


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding(hashlib.sha256(vocabulary).hexdigest(), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base: leftmost matches per kind that don't overlap, those too short dropped afterwards."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encoding: tiktoken.Encoding, ratio: float, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that are neither known forms nor overlap the base, with at most ``ratio`` characters per token."""
    found, at, reached = [], 0, 0
    for m in RUN.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        while at < len(base) and base[at][0] < end:  # the base is sorted, so both are gone through once
            reached, at = max(reached, base[at][2]), at + 1
        if reached <= start and not KNOWN.fullmatch(run) and len(run) <= ratio * len(encoding.encode_ordinary(run)):
            found.append((start, 3, end))
    return found


def find_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO, spans_col: str = "spans") -> DataFrame:
    """docs with ``spans_col``: array of (kind, start, end) in code points, by start, then kind: assign, access, hex, random.

    The first three are matches of patterns and always stay; random ones are added where none of them lies.  Null and empty
    texts have none; whole texts are read, however long; each row, repeated ones too, has its own spans; equal places go by
    kind; an empty table gives an empty one; other columns pass through, and one named like ``spans_col`` is replaced.
    vocabulary: file of a tiktoken byte-pair vocabulary on the driver, at most 16 MiB, which is sent to the tasks.
    """
    with open(vocabulary, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"vocabulary of more than {MOST_BYTES} bytes: {vocabulary}")
    sent = docs.sparkSession.sparkContext.broadcast(data)

    @F.arrow_udf(SPANS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        encoding = _encoding(sent.value)
        for batch in texts:
            out = []
            for scalar in batch:
                text = scalar.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, encoding, ratio, base))
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.array(out, pa.list_(kind))

    return docs.withColumn(spans_col, find(docs[f"`{text_col}`"]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", mark: str = "[secret]") -> DataFrame:
    """docs of find_secrets() with each span, or group of overlapping spans, of the text replaced by ``mark``; null text stays null."""
    step = lambda s, x: F.struct(
        F.when(x["end"] <= s["at"], s["text"]).when(x["start"] < s["at"], s["text"])
        .otherwise(F.concat(s["text"], F.substr(F.col(text_col), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("text"),
        F.greatest(s["at"], x["end"]).alias("at"),
    )
    text = F.aggregate(spans_col, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step, lambda s: F.concat(s["text"], F.substr(F.col(text_col), s["at"] + 1, F.char_length(text_col))))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text))
