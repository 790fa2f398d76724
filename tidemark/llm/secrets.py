"""Secret scans by dictionary-primed zstandard novelty.

Three base patterns give their spans in all cases. Beyond them, each run of key-like characters near
a sensitive word, before or after it, is a candidate, and so are runs that follow one another with no word
between, as the lines of a wrapped key do, where any of them is near one. What base spans leave of a candidate
is measured by itself: its marginal compressed size is what a zstandard frame, primed with a
dictionary of code and identifiers, grows by when the candidate follows its surroundings. Words, names
and repeats cost little; a string that costs as much as random letters and digits is incompressible and is reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import utf8

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?i:api|auth|bearer|cert|cred|key|login|passw|private|pwd|secret|sign|token)", re.ASCII)
WORD = re.compile(r"[^\W_]")
TAIL = re.compile(r"""[\x20\t"',\\]*\r?\n[\x20\t"']*([A-Za-z0-9+/_=-]{1,15})(?=["',;]*\s*(?:-----END|\Z|\n))""")
AROUND = 256  # characters of surroundings on each side, in which a sensitive word counts
NOVEL = 0.65  # marginal compressed bytes per character from which a candidate is reported; random base 64 costs 0.75, joined identifiers 0.6 at most
_WORDS = (
    "access account api application argument array async await base begin boolean buffer bytes cache callback catch char class client code config connection const constant "
    "content context continue count create current data database debug decode def default delete dict directory double element else encode end enum environment error event except "
    "export extends false field file final float format from function get global handler hash header host http https import include index init input instance int interface item json "
    "key lambda length level library line list load local log long main map message method model module name namespace new node null number object offset open option output package "
    "parameter parse password path pattern port print private process property protected public query read record request require resource response result return root row schema secret "
    "select self server service session set size source start state static status stream string struct super switch system table target task template test text this thread throw time "
    "token true try type undefined update upper url user util value variable version void while width window with write yield"
)


def dictionary() -> bytes:
    """Raw dictionary content: identifiers in plain, capitalised, joined and assigned forms."""
    names = _WORDS.split()
    lines = [f"{a}_{b} = {a}.{b}({b});\n{a}{b.title()}: \"{b}\", {a.title()}{b.title()}\n{a.upper()}_{b.upper()}=" for a, b in zip(names, names[1:])]
    tail = "".join(f"{k}{s}" for k in ("password", "passwd", "secret", "token", "api_key", "apikey", "Authorization: Bearer ", "private_key") for s in (" = \"", ": ", "=", "\": \""))
    return ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(lines) + tail).encode()


class Scanner:
    def __init__(self):
        import zstandard

        # the dictionary opens the frame, so that its symbols also prime the entropy tables, which raw dictionaries don't
        self.primer = dictionary()
        self.zstd = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(12, min_match=3, write_content_size=False))

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes per character of a candidate among its surroundings."""
        around = self.primer + (after + "\n" + before).encode("utf-8", "replace")
        cost = len(self.zstd.compress(around + candidate.encode("utf-8", "replace"))) - len(self.zstd.compress(around))
        return cost / len(candidate)

    def novel(self, text: str, s: int, e: int) -> bool:
        return self.novelty(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]) >= NOVEL

    def tail(self, text: str, chain, added) -> tuple[int, int] | None:
        """The last line of a wrapped key, too short for a candidate: it follows two reported lines of one length, or one and comes before -----END."""
        s, e = chain[-1]
        m = TAIL.match(text, e)
        if not m or not added or added[-1][:2] != (s, e):
            return None
        wrapped = len(chain) > 1 and added[-2:-1] == [(*chain[-2], "novel")] and chain[-2][1] - chain[-2][0] == e - s
        return m.span(1) if wrapped or text[m.end() : m.end() + 16].lstrip("\"',; \t\r\n").startswith("-----END") else None

    def scan(self, text: str, raw: bytes | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and added spans (start, end, kind), in code points, each by start and kind."""
        raw = (text.encode("utf-8", "replace") if raw is None else raw).lower()
        base = []
        if any(k in raw for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
            base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if b"akia" in raw:
            base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        base.sort(key=lambda x: (x[0], x[2]))
        added, covered = [], _union(base)
        for chain in _chains(text):
            if not SENSITIVE.search(text, max(0, chain[0][0] - AROUND), chain[-1][1] + AROUND):
                continue
            for s, e in chain:
                added += [(a, b, "novel") for a, b in _outside(s, e, covered) if self.novel(text, a, b)]
            tail = self.tail(text, chain, added)
            if tail:
                added += [(a, b, "novel") for a, b in _outside(*tail, covered)]
        return [(s, e, KINDS[k]) for s, e, k in base], added


def _chains(text: str) -> list[list[tuple[int, int]]]:
    """Candidates, those that follow one another with no letter or digit between in one list."""
    out = []
    for m in CANDIDATE.finditer(text):
        if out and not WORD.search(text, out[-1][-1][1], m.start()):
            out[-1].append(m.span())
        else:
            out.append([m.span()])
    return out


def _union(base) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover, which are by start; both ascend."""
    starts, ends = [], []
    for s, e, _ in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _outside(s: int, e: int, covered) -> list[tuple[int, int]]:
    """What the covered places leave of a candidate."""
    starts, ends = covered
    out = []
    for k in range(bisect_right(ends, s), len(starts)):
        if starts[k] >= e:
            break
        if starts[k] > s:
            out.append((s, starts[k]))
        s = ends[k]
    return [*out, (s, e)] if s < e else out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of likely secrets in every whole text.

    Returns (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel), one row per row of docs.
    spans joins kind:start:end of all base and added spans by start, then kind as listed (novel last);
    base_sha256 is of the base spans alone, so joined. Starts and ends are code points, the end is exclusive.
    Base matches of one kind never overlap, those of different kinds may; added ones overlap none. A
    candidate for an added span is a run of 16 or more letters, digits and + / _ = - within AROUND characters of a
    sensitive word, or in one chain with such a run; a dot ends a run, so that dotted keys are measured part by part. Null
    texts are empty and have no span; rows that repeat an id are scanned each; an empty table gives an empty result, and
    other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for raw in utf8(batch.column(1)):
                base, added = scanner.scan(raw.decode("utf-8", "replace"), raw)
                every = sorted([*base, *added], key=lambda x: (x[0], (*KINDS, "novel").index(x[2])))
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(added)))
            columns = list(zip(*rows)) or [()] * 6
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{n: pa.array(c, t) for n, c, t in zip(names, columns, types)}})

    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """Replace every span that a scan reports by a mark; the number of characters follows where there is such a column.

    All columns and rows of docs are kept; null texts stay null. Overlapping spans become one mark.
    """

    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            texts = []
            for t in batch.column(at).to_pylist():
                base, added = scanner.scan(t) if t else ([], [])
                end = 0
                out = []
                for s, e, _ in sorted([*base, *added]):
                    if s >= end:
                        out += [t[end:s], mark]
                    end = max(end, e)
                texts.append("".join([*out, t[end:]]) if t else t)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                i = names.index(length_col)
                columns[i] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(i).to_pylist())], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
