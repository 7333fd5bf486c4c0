"""Operator 4, secret scans by dictionary-primed zstandard novelty.

A candidate is a string assigned to, or quoted after, a name that speaks of credentials, or a private key block. It is
compressed with zstandard primed by a dictionary of common identifiers and the code around the candidate. What it adds in
bytes is its novelty: words, paths, placeholders and repeats of the code around cost little, random strings cost nearly
their length. Candidates that do not compress are reported, without the secret itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, slices, texts

#: Characters of the text before and after a candidate that are its surrounding code and prime the dictionary. Candidates are read whole, however long.
AROUND = 2048
#: Shortest candidate, and share of the bytes that a random string of its kind costs from which it is reported.
SHORTEST, NOVELTY = 12, 0.8
#: Mean letters of the words in a bare value from which it is prose or an identifier, its words, and what joins them.
LONG = 3.5
HUMP = re.compile(r"[^\W\d_a-z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
JOINTS = "_.-:/=|!?*&$@#"
LEVEL = 9
#: Runs that names and bare words are, the words in a name that speak of credentials, and names of two words.
RUN = re.compile(r"[\w.-]+")
WORD = re.compile(r"(?i)token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|client[_-]?key|signature|session[_-]?id")
TWO = re.compile(r"(?i)(?:api|access|private|client)$")
#: What stands between a name and its value, a quoted value, and the stretch in which a bare one lies.
BETWEEN = re.compile(r"""(?i)["']?+(?:\s*+(?:[:=]{1,2}+>?+)\s*+|\s++)(?:bearer\s++)?""")
QUOTED = re.compile(rf"""(["'`])([^"'`\s]{{{SHORTEST},}}+)\1""")
BARE = re.compile(r"""[^\s"'`()\[\]{}<>,;]++""")
MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
BLOCK = re.compile(r"[\w+/=\s:,.\\-]++")
#: What a text must match for its candidates to be looked for; the same words, for Spark.
SPARK = r"(?i)(token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|private[\s_-]?key|credential|auth|bearer|client[ _-]?key|signature|session[_-]?id)"
#: Strings that code is full of: names, placeholders, alphabets. The last bytes are the cheapest to refer to.
IDENTIFIERS = " ".join(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 0123456789abcdef 1234567890 0000000000000000 ffffffffffffffff xxxxxxxxxxxxxxxx "
    "example sample dummy placeholder changeme change-me your_api_key_here YOUR-TOKEN-HERE insert_secret_here replace_with test123456 password123 "
    "process.env. os.environ getenv System.getProperty config.get settings. self. this. request.headers https:// http:// localhost 127.0.0.1 example.com "
    "function return class public private static const import from None null true false undefined string integer boolean required optional "
    "access_token refresh_token token_type authorization bearer client_id client_secret api_key apikey secret_key private_key password username credentials session_id signature "
    "get_token set_token create_token validate_token decode_token encode_token user_password hash_password verify_password application/json content-type".split(" ")
).encode()
#: Bytes from which zstandard codes literals by their frequency, and the symbols of common alphabets, smallest first.
CODED = 64
ALPHABETS = [(re.compile(k), n) for k, n in ((r"\d+", 10), (r"[\da-f]+|[\dA-F]+", 16), (r"[a-z]+|[A-Z]+", 26), (r"[\w+/=-]+", 64), (r"[!-~]+", 94))]
SCHEMA = "doc_id bigint, start int, end int, name string, preview string, digest string, length int, marginal_bytes int, novelty double"


def marginal(candidate: bytes, around: bytes) -> int:
    """Bytes that the candidate adds to a frame that knows the identifiers and the code around."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    packer = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)
    return max(0, len(packer.compress(candidate)) - len(packer.compress(b"")))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of candidates, in order, in time linear in the text: every run of word characters is looked at once.
    Candidates may overlap: the word behind a name may be the name of the next. A bare value ends where the next name with a
    value begins, and bare values that are words or identifiers are none. A key block is what stands between a BEGIN and the next mark, if that is an END."""
    found: list[tuple[int, int, str]] = []
    marks = list(MARK.finditer(text))
    for m, n in zip(marks, marks[1:]):
        if m[1] == "BEGIN" and n[1] == "END" and BLOCK.fullmatch(text, m.end(), n.start()):
            found.append((m.end(), n.start(), m[2].strip()))
    bare: list[tuple[int, int, str]] = []
    before, stretch = None, (0, 0)
    for m in RUN.finditer(text):
        start, end = m.span()
        if not WORD.search(text, start, end):
            two = before is not None and text[before[1] : start] == " " and text[start : start + 3].lower() == "key" and TWO.search(text, before[0], before[1])
            before = start, end
            if not two:
                continue
            start = two.start()
        before = start, end
        m = BETWEEN.match(text, end)
        if not m:
            continue
        name, at = text[start:end], m.end()
        if q := QUOTED.match(text, at):
            found.append((q.start(2), q.end(2), name))
            continue
        if not stretch[0] <= at < stretch[1]:
            stretch = v.span() if (v := BARE.match(text, at)) else (at, at)
        if bare and start < bare[-1][1]:
            low, _, other = bare[-1]
            bare[-1] = low, max(low, start), other
        bare.append((at, max(at, stretch[1]), name))
    for start, end, name in bare:
        if end - start >= SHORTEST and not _wordlike(text[start:end]):
            found.append((start, end, name))
    yield from sorted(found, key=lambda x: (x[0], -x[1]))


def judge(text: str, start: int, end: int) -> tuple[int, float]:
    """Marginal bytes of text[start:end] and their share of what a random string of its kind costs. Other places of the same string are blanked in the
    code around, or a secret that is written twice would look known."""
    secret = text[start:end]
    around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).replace(secret, " ")
    data = secret.encode("utf-8", "replace")
    cost = marginal(data, around.encode("utf-8", "replace"))
    return cost, cost / random_size(secret, len(data))


def random_size(secret: str, size: int) -> float:
    """Bytes that a random string of the secret's length and alphabet costs; size: the secret's own bytes."""
    if size < CODED:
        return size
    tight = re.sub(r"\s", "", secret)
    symbols = next((n for kind, n in ALPHABETS if tight.isascii() and kind.fullmatch(tight)), 256)
    return size * math.log2(symbols) / 8


def _wordlike(value: str) -> bool:
    """Whether a value without quotes reads as prose or code: letters and joints only, in words of some length."""
    humps = HUMP.findall(value)
    letters = sum(map(len, humps))
    return letters >= LONG * len(humps) and letters + sum(c in JOINTS for c in value) == len(value)


def scan(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """A row for each secret: doc_id, start and end (characters), name (the text before it), preview (its first 4
    characters), digest (SHA-256), length, marginal_bytes and novelty (marginal bytes a byte of a random string of its alphabet).

    Whole texts are read, in linear time. Null and empty texts have none. Repeated rows give repeated rows, and a null doc_id is carried along. A secret
    that stands in a text several times has a row for each place. Of reported candidates that overlap the first counts. A
    value without quotes that is letters only and reads as words is taken for prose or code and not measured. An empty table gives an empty result. Other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
        for piece in slices(batches, "text"):
            out = []
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                at = -1
                for start, end, name in candidates(text):
                    if start < at:
                        continue
                    secret = text[start:end]
                    cost, share = judge(text, start, end)
                    if share >= novelty:
                        at = end
                        out.append((doc, start, end, name, secret[:4], hashlib.sha256(secret.encode("utf-8", "replace")).hexdigest(), end - start, cost, round(share, 4)))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=names)

    source = texts(docs, "doc_id", "text").filter(F.col("text").rlike(SPARK)).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrow(source, find, SCHEMA)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
