"""Secret scanning: fixed patterns, and dictionary-primed compression novelty.

Patterns: assignments to a sensitive name, access key ids and long hexadecimal runs, each leftmost and
non-overlapping, kept where long enough. These are always reported.

Identifiers of the corpus (words joined by underscores or by capitals, without digits) are counted over all texts, and
the commonest go into the dictionary beside the fixed names.

Novelty: other long tokens that begin shortly after a sensitive word, which may stand inside a name, are
candidates; `name=value` is two of them. The bytes that a candidate adds to a zstandard frame are
`size(context + candidate) - size(context)`, where the compressor is primed with a dictionary of identifiers and
the context is the text around the candidate, less exact copies of it: a secret that stands twice does not explain itself. Names, paths and words that the dictionary or the surroundings
explain add little; a random credential adds as much as any random string of its alphabet (digits, hexadecimal
digits, small letters, capitals, the signs it has) in its place. A candidate's novelty is its bytes over those of
such strings, measured in the same context; at `least_ratio` or more it is reported as kind `novel`.

Work is linear in the text: a candidate costs one bounded context. Texts are read whole, one Arrow batch at a time.

Defined results: a null text is an empty one and has no span; equal texts have equal spans; offsets are code
points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, sliced

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[-_ ]?key|access[-_ ]?key|private[-_ ]?key|credential|auth(?:orization)?|bearer|signature|client[-_ ]id)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]+")
PIECE = re.compile(r"[^=]+(?:=+$)?")  # of a candidate: what stands between equals signs, with the padding at the end
LONG = 16
#: A text without any of these has no sensitive word; `HEX_BYTES` maps hexadecimal digits to h, so that a long run is found as a substring.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"access", b"private", b"credential", b"auth", b"bearer", b"signature", b"client")
HEX_BYTES = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
REACH = 48  # characters after a sensitive word in which a candidate may begin
AROUND = 256  # characters of context on each side
NAMES = """get set value index config settings password secret token api key access private public client user name
server host port path file http https www com org net json xml yaml true false null none self this return import from class
def function const let var int string bool list dict map array object request response header content type length default
environment variable example placeholder changeme your_password_here your_api_key_here xxxxxxxxxxxxxxxx 0123456789abcdef
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ application/json authorization bearer database connection localhost
src main java python com org app test lib build target service default local proxy http https port 8080 reset expires
config_settings_value_0 application_settings user_session_timeout_seconds access_token_expires_at refresh_token_url client_id
https_proxy_server_port http_server_host_name x86_64-unknown-linux-gnu aarch64-apple-darwin release-1.0.0-rc1-linux-x86_64
my-blog-post-about-security-2024 docs/v1/reference/authentication-guide sha256_digest_of_the_payload utf8_string_to_base64_encoder
oauth2.client oauth2.provider getUserTokenFromHttpRequest AbstractAuthenticationFilter EC2InstanceProfileRoleName 2024-01-01T00:00:00.000Z
getElementById addEventListener toString hashCode equals implements extends override readonly undefined prototype constructor
""" # identifiers and placeholders, the dictionary's content


def alike(candidate: str, n: int = 4) -> list[str]:
    """Random strings of the candidate's alphabet and length, its signs in their places; the same ones each time."""
    kept = set(candidate)
    if kept & set(string.digits) and not kept & set(string.ascii_letters) - set("abcdef") or not kept & set(string.ascii_letters) - set("ABCDEF"):
        letters = "0123456789" + ("abcdef" if kept & set("abcdef") else "ABCDEF")
    else:
        letters = "".join(x for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if kept & set(x))
    out = []
    for k in range(n):
        raw = hashlib.shake_128(f"{k}{candidate}".encode()).digest(2 * len(candidate))
        out.append("".join(letters[int.from_bytes(raw[2 * i : 2 * i + 2], "big") % len(letters)] if c.isalnum() else c for i, c in enumerate(candidate)))
    return out


class Scanner:
    def __init__(self, least_ratio: float = 0.8, names: str = NAMES):
        self.least_ratio = least_ratio
        primed = zstandard.ZstdCompressionDict(names.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes of the candidate among its surroundings without copies of it, over those of random strings like it."""
        around = f"{before}\n{after}\n".replace(candidate, "").encode("utf-8", "replace")
        alone = len(self.compressor.compress(around))
        own, *others = (len(self.compressor.compress(around + c.encode())) - alone for c in (candidate, *alike(candidate)))
        return own * len(others) / max(1, sum(others))

    def base(self, text: str, hinted: bool = True, hexes: bool = True) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterns' spans."""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if hinted else []
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)] if hexes else []
        return sorted(found)

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The patterns' spans, and all with the novel ones, as (start, kind, end)."""
        text = text or ""
        raw = text.encode("utf-8", "replace")
        lower = raw.lower()
        hinted = any(h in lower for h in HINTS)
        base = self.base(text, hinted, b"h" * 16 in raw.translate(HEX_BYTES))
        if not hinted:
            return base, base
        novel: list[tuple[int, int, int]] = []
        starts = [a for a, _, _ in base]
        reach: list[int] = []  # the furthest end of the patterns' spans up to each
        for _, _, end in base:
            reach.append(max(end, reach[-1]) if reach else end)
        done = 0
        for word in SENSITIVE.finditer(text):
            # A run may go past the reach; its pieces that begin within count whole, and each is looked at once.
            at, last = max(done, word.end()), word.end() + REACH
            while (run := CANDIDATE.search(text, at)) and run.start() < last:
                at = run.end()
                for m in PIECE.finditer(text, run.start(), run.end()):
                    if m.start() >= last:
                        at = m.start()
                        break
                    a, b = m.span()
                    done = b
                    if b - a < LONG or not (re.search(r"\d", m.group()) and re.search(r"[A-Za-z]", m.group())):
                        continue
                    k = bisect.bisect_right(starts, a)
                    if k and reach[k - 1] >= b:  # within what the patterns report
                        continue
                    if self.novelty(text[max(0, a - AROUND) : a], m.group(), text[b : b + AROUND]) >= self.least_ratio:
                        novel.append((a, 3, b))
                if at < run.end():
                    break
        return base, sorted(base + novel)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by [SECRET]."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


IDENTIFIER = r"\b[a-z]+(?:_[a-z]+)+\b|\b[A-Z]+(?:_[A-Z]+)+\b|\b[a-z]+(?:[A-Z][a-z]+)+\b|\b(?:[A-Z][a-z]+){2,}\b"


def names_of(docs: DataFrame, most: int = 300, longest: int = 60) -> str:
    """The fixed names, and the `most` commonest identifiers of all texts, the commonest last: a dictionary's end is nearest."""
    found = docs.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("name")).where(F.length("name") <= longest)
    top = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most).collect()
    return " ".join([*(r["name"] for r in reversed(top)), NAMES])


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every row of docs."""
    names = names_of(docs)

    def make():
        scanner = Scanner(names=names)

        def of(text: str | None) -> tuple:
            base, every = scanner.spans(text)
            n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            return *n[:3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), n[3]

        return of

    return over_texts(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced, and n_chars to match; texts without a secret stay as they are."""
    names = names_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(names=names)
        for b in sliced(batches):
            texts = [t if t is None or not (s := scanner.spans(t)[1]) else redacted(t, s) for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
