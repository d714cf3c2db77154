"""Secret scans: fixed patterns, and strings that zstandard cannot explain from what is around them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
# fixed patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# words around which a string that nothing explains is likely to be a secret
SENSITIVE = re.compile(r"(?:passw|passwd|secret|token|api.?key|credential|private|auth|bearer|signature|licen[cs]e.?key)", re.I | re.A)
SHORTEST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: a run is judged on this many characters first, and on all of it where they do not suffice
HEAD = 512
# what continues a reported run: parts joined by dots, the last one long; lines that hold nothing else
DOTTED = re.compile(r"(?:\.[A-Za-z0-9+/_=-]*)*\.[A-Za-z0-9+/_=-]{20,}")
LINE = re.compile(r"""(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)([A-Za-z0-9+/_=-]+)(?=[ \t]*(?:\r?\n|\\r|\\n|["'`,;]|\Z))""")
LAST = re.compile(r"(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)-----END")
IDENTIFIERS = (b"username password passwd secret token api_key apikey access_key private_key client_id client_secret "
               b"authorization bearer credential signature session cookie header request response config settings "
               b"environment variable production development staging endpoint connection database localhost "
               b"import return function class public static private const string value default null true false "
               b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http://www. https:// .com/ .org/ "
               b"example placeholder changeme xxxxxxxx your_token_here your-api-key-here")


class Novelty:
    """Compressed bytes that a string adds to what stands around it."""

    def __init__(self, level: int = 3):
        self.level = level

    def marginal(self, before: bytes, candidate: bytes, after: bytes) -> int:
        """Size of the candidate less that of nothing, primed with the identifiers and both sides."""
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + after + b"\n" + before, zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False,
                                          write_checksum=False, write_dict_id=False)
        return len(packer.compress(candidate)) - len(packer.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: alphabets of keys and the bits a character of each can carry; a run of any other signs has 6
ALPHABETS = ((re.compile(r"[0-9A-F]+|[0-9a-f]+"), 4.0), (re.compile(r"[A-Z2-7]+=*|[a-z2-7]+=*"), 5.0), (re.compile(r"[0-9A-Z]+|[0-9a-z]+"), 5.17))


def _bits(run: str) -> float:
    """What a character of a run can carry at most: no coder makes random signs of its alphabet smaller than that."""
    return next((bits for alphabet, bits in ALPHABETS if alphabet.fullmatch(run)), 6.0)


def _continued(text: str, start: int, end: int, novel) -> int:
    """Where the run ``start`` to ``end`` ends with its dot-joined parts and the lines of its block.

    A line belongs to the block if it is as wide as the first one or is novel by itself. A shorter
    line than candidates are is the last one, if it has more than letters or the end mark follows.
    """
    dotted = DOTTED.match(text, end)
    if dotted:
        return dotted.end()
    escaped = text.startswith("\\n", start - 1)  # the n of a written line break is not of the first line
    width = end - start - escaped
    while m := LINE.match(text, end):
        a, b = m.span(1)
        line = m.group(1)
        if not re.search("[A-Za-z0-9]", line):
            break
        if b - a == width or b - a >= SHORTEST and novel(a, b):
            end = b
            continue
        if b - a < min(width, SHORTEST) and (re.search("[0-9+/=]", line) or LAST.match(text, b)):
            end = b
        break
    return end


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, reach: int = 256,
                near: int = 48, share: float = 0.7) -> list[tuple[int, int, int]]:
    """Strings that start within ``near`` characters after a sensitive word and add ``share`` of their length.

    The share is that of six bits a character; a run of fewer signs (hexadecimal, base 32, base 36) needs as
    much less as its alphabet carries, so its length does not decide. Strings have letters and digits and any length; those that overlap a base span are left to it.
    A string goes on over its dot-joined parts or the further lines of its block, also after a
    base span. Runs are found in one pass; a word within a run starts it anew.
    """
    words = [m.end() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text, words[0])]
    taken: list[list[int]] = []
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    begins = [a for a, _ in taken]
    spare = "+/_=-"
    known: dict[int, bool] = {}
    ends: dict[int, tuple[int, int]] = {}
    size: dict[int, int] = {}

    def added(start: int, end: int) -> int:
        before, after = text[max(0, start - reach):start].encode(), text[end:end + reach].encode()
        return novelty.marginal(before, text[start:end].encode(), after)

    def novel(start: int, end: int) -> bool:
        if end not in ends:  # behind the last digit, behind the last letter
            run = text[start:end]
            ends[end] = (start + len(run.rstrip(LETTERS + spare)), start + len(run.rstrip(DIGITS + spare)))
        if min(ends[end]) <= start:
            return False
        head = min(end, start + HEAD)
        need = share * _bits(text[start:end]) / 6
        if added(start, head) >= need * (head - start):
            return True
        # the rest of a run takes no more than the run did, but for the frame
        if head == end or end in size and size[end] + 64 < need * (end - start):
            return False
        size[end] = added(start, end)
        return size[end] >= need * (end - start)

    out: list[tuple[int, int, int]] = []
    at = 0
    for word in words:
        while at < len(runs) and runs[at][1] - word < SHORTEST:
            at += 1
        for begin, end in runs[at:at + near // SHORTEST + 2]:
            start = max(begin, word)
            if start - word > near:
                break
            if out and start < out[-1][2]:
                continue
            if start not in known:
                known[start] = novel(start, end)
            if not known[start]:
                continue
            k = bisect_right(begins, end - 1) - 1
            if k >= 0 and taken[k][1] > start:
                stop = max(end, taken[k][1])
                more = _continued(text, start, stop, novel)
                if more > stop:
                    out.append((taken[k][1], 3, more))
                continue
            out.append((start, 3, _continued(text, start, end, novel)))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def _scan(mark: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [sorted(b + novel_spans(t, b, novelty)) for t, b in zip(texts, base, strict=True)]
                if mark is not None:
                    clean = [redact(t, s, mark) if s else t for t, s in zip(texts, every, strict=True)]
                    clean = pa.array([c if raw.is_valid else None for c, raw in zip(clean, part.column("text"), strict=True)], pa.string())
                    yield part.set_column(part.schema.get_field_index("text"), "text", clean)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)),
                     pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]),
                     pa.array([_joined(s) for s in every])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def secret_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Secrets of every text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Assignments, access keys and hexadecimal strings are found by patterns. Further strings near
    a sensitive word are candidates: each is compressed with a zstandard dictionary of common
    identifiers and the text around it, and is reported as ``novel`` where it, or its first 512
    characters, still takes 70 % of its length (of six bits a character; less in smaller alphabets).
    A key of letters only and one that stands before its word are not candidates, as ordinary long words
    and identifiers stand there too. Candidates have any length; a reported one goes on
    over dot-joined parts and adjoining lines (tokens in three parts, key blocks). Ordinary words, repeated values and placeholders are explained by the dictionary.

    Documents never move. Null and empty texts have no spans; repeated rows have the same result;
    other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _scan(None), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_secrets(spark: SparkSession, docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """All rows and columns, with every span of the text replaced by ``mark``; null stays null."""
    return docs.mapInArrow(_scan(mark), docs.schema)
