"""Operator 2: secrets as incompressible strings in a sensitive context.

Candidates are values in a sensitive context: assigned to a sensitive name (``token = "``,
``apiKey:``, ``<password>``, ``--secret``), after ``Bearer`` or ``Basic``, the password of a
URL, the body of a private key block, and strings with an issuer's prefix.  A candidate's
marginal bytes are those that zstandard adds for it to a frame of its surroundings, primed
by a dictionary of common code identifiers and of the corpus's own most frequent
sub-words.  Its novelty is their ratio to what a random string of the same alphabet and
length adds: names made of known sub-words take less than half of it, random ones all.

Case is folded and camelCase, snake_case and paths are cut into sub-words before
compression, in the dictionary as in texts and candidates, so that each word needs to be
known in one form only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, written
from .quality import kth_largest

#: Shortest value looked at, in bytes; shorter strings carry too few bytes to measure.
MIN_LENGTH = 8
#: Bytes of text on either side in the frame; in larger frames the entropy coder's own changes drown the candidate's bytes.
SURROUNDINGS = 96
#: Least share of a random string's bytes, random strings that this is the mean of, least bytes in all, zstandard's level.
NOVELTY, DRAWS, LEAST, LEVEL = 0.68, 4, 6, 12
#: Corpus sub-words in the dictionary (it is the most frequent ones that help) and their lengths.
WORDS, SHORTEST, LONGEST = 4000, 4, 40
IDENTIFIERS = """
abstract access_token account activate address algorithm allowed api_key api_secret application argument array assert async attribute auth_token
authenticate authorization await backend base64 basic bearer boolean buffer bytes cache callback certificate changeme channel class client client_id
client_secret column config configuration connect connection constant container content context continue controller cookie count create credential
current database dataset debug decode default delete description development dictionary disabled document domain download driver element email enabled
encode encoding encryption endpoint environment error example example_token exception execute export extends false field filename final float folder
format frontend function generate getElementById github global handler hash header hostname identifier implements import index initialize input insert instance
integer interface internal invalid iterator javascript json key lambda length library license local localhost location logger login manager
message metadata method model module namespace network nullable number object operator option output package parameter parent parse passphrase
password path pattern payload placeholder platform plugin pointer port prefix private private_key process production profile project property protected
protocol provider public public_key query random readonly receive record redirect refresh_token register relative release remote repository request required
resource response result return revision route sandbox schema scope script secret secret_key security select sequence server service session
session_id settings signature socket source stack standard static status storage stream string struct structure style submit subscribe success
suffix symbol system table target template temporary test_token testing text thread timeout timestamp token transaction transform true type undefined
unique update upload uri url user_id username utf-8 validate validation value variable vector version virtual void warning webhook widget window
your_api_key your_secret_here your_token_here xxxxxxxx 00000000 12345678 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
"""

_NAMED = rb"(?:(?<![A-Za-z])(?i:key|auth|pwd|pass|private|signature)|(?<=[a-z0-9])(?:Key|Auth|Pwd|Pass|Private|Signature)|(?i:api_?key|secret|token|passw(?:or)?d|passphrase|credential|authorization|(?:access|private|encryption)key))"
#: What may follow within the name, so that keyboards, authors, tokenizers and secretaries are none.
_SUFFIX = rb"(?!(?i:ors?|words?|boards?|izers?|ary)\b)(?:s\b|[_\-.A-Z0-9][\w\-.]*)?"
_VALUE = rb"""(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|`(?P<t>[^`\n]*)`|(?P<bare>[^\s"'`<>,;(){}\[\]&]+))"""
_ASSIGNED = re.compile(rb"(?P<name>" + _NAMED + _SUFFIX + rb""")["'\]]{0,2}(?:[ \t]*(?::=|=>|==|=|:|>)|(?<=[\w\-])(?=[ \t]+)(?P<flag>))\s*(?i:(?:bearer|basic|token)\s+)?[(\[]?""" + _VALUE)
_BEARER = re.compile(rb"\b(?i:(?P<name>bearer|basic))[ \t]+(?P<bare>[A-Za-z0-9._~+/=\-]{16,})")
_URL = re.compile(rb"(?P<name>[A-Za-z][A-Za-z0-9+.\-]*)://[^\s:/@\"']*:(?P<bare>[^\s@\"'/]+)@")
_BLOCK = re.compile(rb"-----BEGIN (?P<name>[A-Z ]*PRIVATE KEY)-----(?P<block>[^-]+)")
_ISSUED = re.compile(rb"\b(?P<name>AKIA|ASIA|gh[pousr]_|glpat-|xox[abeoprs]-|sk_live_|sk-|AIza|SG\.)(?P<bare>[A-Za-z0-9_\-.]{12,})")
#: A text without any of these holds no candidate.
_PREFILTER = "(?i)key|secret|token|passw|pass|pwd|credential|auth|bearer|basic|private|signature|://|akia|asia|gh[pousr]_|glpat|xox|sk_live|sk-|aiza|sg\\."
_CAMEL = re.compile(rb"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_BETWEEN = re.compile(rb"[\s_\-/.:+=\"'\\]+")


def fold(text: bytes) -> bytes:
    """text in small letters, its identifiers and paths cut into sub-words."""
    return _BETWEEN.sub(b" ", _CAMEL.sub(b" ", text)).lower()


#: The second frame: every seventh identifier.
SAMPLE = b" ".join(fold(IDENTIFIERS.encode()).split()[::7])


def dictionary(words: list[bytes]) -> bytes:
    """zstandard takes the end of a raw dictionary as nearest, so the most frequent words come last."""
    return fold(b" ".join(words[::-1]) + b" " + b" ".join(IDENTIFIERS.encode().split()))


_CLASSES = (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NARROW = (b"0123456789", b"0123456789abcdef", b"0123456789ABCDEF")


def alphabet(candidate: bytes) -> bytes:
    """Digits, hexadecimal digits of one case, or all of the kinds of letters and digits that occur and the other bytes."""
    own = set(candidate)
    known = b"".join(x for x in _CLASSES if own & set(x))
    return next((x for x in _NARROW if own <= set(x)), None) or known + bytes(sorted(own - set(known)))


class Meter:
    """Marginal bytes under a dictionary."""

    def __init__(self, raw: bytes):
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, known: bytes, candidate: bytes) -> int:
        """Compressed bytes that the candidate adds to a frame."""
        return len(self.zstd.compress(known + b" " + fold(candidate))) - len(self.zstd.compress(known))

    def measured(self, before: bytes, candidate: bytes, after: bytes) -> tuple[int, float]:
        """(marginal bytes, their ratio to those of DRAWS random strings of the same alphabet and length), the lesser ratio of two frames.

        One frame is the surroundings without other copies of the candidate, the other one a
        fixed sample of identifiers, where the entropy coder is as it is for code.
        """
        letters, n = np.frombuffer(alphabet(candidate), np.uint8), len(candidate)
        other = [letters[np.random.default_rng([n, k]).integers(0, len(letters), n)].tobytes() for k in range(DRAWS)]
        found = []
        for known in (fold(after.replace(candidate, b"") + b" " + before.replace(candidate, b"")), SAMPLE):
            cost = self.added(known, candidate)
            found.append((cost / max(1.0, sum(self.added(known, x) for x in other) / DRAWS), cost))
        novelty, cost = min(found)
        return cost, novelty


def candidates(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, context) in bytes of the values in a sensitive context, in order, none inside another one."""
    found = {}
    for pattern in (_BLOCK, _URL, _ISSUED, _BEARER, _ASSIGNED):
        for m in pattern.finditer(text):
            kind = m.lastgroup if m.lastgroup != "flag" else "bare"
            a, b = m.span(next(g for g in (kind, "bare", "d", "s", "t", "block") if g in m.groupdict() and m[g] is not None))
            if pattern is _ISSUED:
                a = m.start()
            if pattern is _ASSIGNED:
                if m["flag"] is not None and not re.search(rb"(?:^|\s)--?[\w\-]*$", text[max(0, m.start() - 64) : m.start()]):
                    continue
            spans = [(a, b)] if pattern is _BLOCK else [(a + x.start(), a + x.end()) for x in re.finditer(rb"\S+", text[a:b])]
            for x, y in spans:
                if pattern is not _BLOCK:
                    y = x + len(text[x:y].rstrip(b".:!?"))
                if y - x >= MIN_LENGTH and b"://" not in text[x:y]:
                    found.setdefault((x, -y), m["name"].decode().lower())
    out, last = [], -1
    for (x, y), name in sorted(found.items()):
        if -y > last:
            out.append((x, -y, name))
            last = -y
    return out


def _characters(text: bytes) -> int:
    return len(text) - sum(text.count(bytes([b])) for b in range(0x80, 0xC0)) if not text.isascii() else len(text)


KIND = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "name": pa.string(), "masked": pa.string(), "marginal_bytes": pa.int64(), "novelty": pa.float64()}


def _scan(raw: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(raw)
        for batch in batches:
            rows = []
            for k in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(batch.column(1), _PREFILTER), False)).to_pylist():
                text = batch.column(1)[k].as_buffer().to_pybytes()
                for a, b, name in candidates(text):
                    cost, novelty = meter.measured(text[max(0, a - SURROUNDINGS) : a], text[a:b], text[b : b + SURROUNDINGS])
                    if cost >= LEAST and novelty >= NOVELTY:
                        shown = text[a:b].decode(errors="replace")
                        open_ = min(4, len(shown) // 4)
                        rows.append((batch.column(0)[k].as_py(), _characters(text[:a]), len(shown), name, shown[:open_] + "*" * (len(shown) - open_), cost, novelty))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), KIND.values())], list(KIND))

    return run


def frequent_words(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The corpus's most frequent sub-words (letters and up to four digits), counted over all documents; ties in byte order."""
    camel = F.lower(F.regexp_replace(F.col(f"`{text_col}`"), r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " "))
    words = docs.select(F.explode(F.split(camel, r"[^\p{L}\p{Nd}]+")).alias("w")).where(F.length("w").between(SHORTEST, LONGEST) & F.col("w").rlike(r"^\p{L}{3,}\p{Nd}{0,4}$"))
    counted = written(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    # the threshold first, so that the driver gets few words from however many partitions
    top = counted.where(F.col("n") >= kth_largest(counted, "n", WORDS)).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    discard(counted)
    return [r.w.encode() for r in top]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, name, masked, marginal_bytes, novelty): the secrets found.

    start and length count characters, name is the context's keyword, masked shows a
    quarter of the value and four characters at most.  Values under MIN_LENGTH bytes aren't
    looked at; of quoted ones each part between blanks counts by itself.  Every occurrence
    is a row, in each row of docs that holds it, whatever its id; null and empty texts give
    none.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(_scan(dictionary(frequent_words(docs))), "doc_id bigint, start bigint, length bigint, name string, masked string, marginal_bytes bigint, novelty double")
