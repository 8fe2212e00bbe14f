"""Secret scans: fixed patterns, and strings that a dictionary-primed compressor finds novel.

Base spans come from three patterns. Beyond them, a long mixed string in a sensitive context is a
candidate; its novelty is what it adds to the compressed size of the text around it, with zstandard primed
by a dictionary of common words, identifiers and code. A random key adds nearly its full entropy, a path
or a name little. Lines of a block and segments of a token share their context, and all copies of a
reported string are reported. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base kinds in order; the pattern, and the least length of the group that counts.
BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = tuple(k for k, *_ in BASE) + ("novel",)

#: What may be a secret, the words that make a context sensitive, and how far before or after it they may stand.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"auth|bearer|credential|private|passphrase|pwd|pass|secret|token|key|akia|signature|cookie|session", re.IGNORECASE | re.ASCII)
CONTEXT_CHARS, SURROUNDING_CHARS = 48, 512
#: What may stand between candidates that share their context: lines of a block, segments of a token.
ADJOINING = re.compile(r"""[\s.,:;~|"'`\\+#>*-]{1,16}""")
#: The last, short line of a block.
TAIL = re.compile(r"""[\s"'`\\+]{1,8}([A-Za-z0-9+/=]{1,15})(?=[\s"'`\\+]{0,8}-----END)""")
#: Compressed bytes that a candidate adds, for each of its characters, from which it is reported, and the compressor's
#: level. Of planted keys 99 in 100 add more, of names made of words 1 in 10 (tests): no bound tells all apart.
NOVELTY, LEVEL = 0.75, 12

#: Words that identifiers are made of; the dictionary has them in lower case and capitalised.
IDENTIFIER_WORDS = (
    "account address amount array base batch block buffer build button cache call change channel check child class client code "
    "color column command comment config connection content context control copy count create current customer data database "
    "date default delete description detail device directory document domain edit element email entry environment event export "
    "field file filter flag folder format frame function group handler header height host image import index info input insert "
    "instance item job label language layout length level library limit line link list load local location lock log main manager "
    "map master member message method model module month name network node number object offset option order output owner page "
    "parameter parent path pattern payload payment phone point policy port position process product profile project property "
    "query queue random range read record region remote report request resource response result role root row rule schema score "
    "search section select service session size sort source state status storage store stream string style system table tag "
    "target task template test text thread time title token total tree type update user value version view window worker year"
)

#: The dictionary that primes the compressor.
DICTIONARY = (
    "the and for with that this from have not are was were will would could should there their which about into over after "
    "der die das und nicht ein eine mit von für auf ist les des une dans pour avec que los las una para con por del como "
    "def class return import from self None True False lambda yield raise except finally while break continue global assert "
    "function const let var new public private protected static final void int long double string boolean null undefined "
    "SELECT FROM WHERE GROUP BY ORDER INSERT UPDATE DELETE CREATE TABLE INDEX VALUES JOIN LEFT INNER ON AS AND OR NOT NULL "
    "http:// https:// www. .com .org .net /index.html /api/v1/ /usr/local/bin /home/user/ /etc/ /var/log/ Content-Type: "
    "application/json text/html charset=utf-8 Authorization: Bearer Basic User-Agent: Mozilla/5.0 Accept: Cookie: Set-Cookie "
    "password = passwd secret_key api_key apikey access_token refresh_token client_id client_secret private_key public_key "
    "username user_id session_id get_value set_value is_valid to_string from_string max_length min_length total_count "
    "error_message file_name path_name line_number created_at updated_at example sample default config options settings "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx ---------------- ================ "
    f"{IDENTIFIER_WORDS} {IDENTIFIER_WORDS.title()}"
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping in each."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    return found


class Novelty:
    """Compressed bytes that a string adds to what stands before it."""

    def __init__(self):
        import zstandard

        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False).compress
        self.added = lru_cache(maxsize=4096)(self._added)  # lines that repeat bring the same string in the same text

    def _added(self, before: str, candidate: str) -> int:
        before = before.encode("utf-8", "replace")
        return len(self.compress(before + candidate.encode())) - len(self.compress(before))


def in_context(text: str, found: list[re.Match]) -> list[bool]:
    """For each candidate: a sensitive word stands shortly before or after it, or it or one of those that adjoin it in a row."""
    own = [bool(SENSITIVE.search(text, max(0, m.start() - CONTEXT_CHARS), m.start()) or SENSITIVE.search(text, m.end(), m.end() + CONTEXT_CHARS)) for m in found]
    first = 0
    for k in range(1, len(found) + 1):
        if k == len(found) or not ADJOINING.fullmatch(text, found[k - 1].end(), found[k].start()):
            own[first:k] = [any(own[first:k])] * (k - first)
            first = k
    return own


def is_mixed(word: str) -> bool:
    return sum((any(c.isdigit() for c in word), any(c.islower() for c in word), any(c.isupper() for c in word))) >= 2


def blanked(text: str, s: int, e: int, spans: list[tuple[int, int]]) -> str:
    """text[s:e] with blanks in place of the spans, which are sorted and don't overlap."""
    s, e, parts = max(0, s), min(len(text), e), []
    k = bisect_right(spans, (s, s))
    k -= k > 0 and spans[k - 1][1] > s
    while k < len(spans) and spans[k][0] < e:
        a, b = max(s, spans[k][0]), min(e, spans[k][1])
        parts += [text[s:a], " " * (b - a)]
        s, k = b, k + 1
    return "".join([*parts, text[s:e]])


def surroundings(text: str, s: int, e: int, spans: list[tuple[int, int]] = ()) -> tuple[str, str]:
    """What stands before and after text[s:e], its copies blanked out, those that the limit would cut among them, and the spans."""
    word, far = text[s:e], SURROUNDING_CHARS + e - s
    before = blanked(text, s - far, s, spans).replace(word, " ")[-SURROUNDING_CHARS:]
    return before, blanked(text, e, e + far, spans).replace(word, " ")[:SURROUNDING_CHARS]


def is_novel(text: str, s: int, e: int, novelty: Novelty, spans: list[tuple[int, int]] = ()) -> bool:
    """text[s:e] is hard to compress after the text before it, and after what follows it as well; spans are blanked out there."""
    before, after = surroundings(text, s, e, spans)
    return novelty.added(after + before, text[s:e]) >= NOVELTY * (e - s)


def value_of(word: str) -> str:
    """The longest part of a candidate between equals signs, or all of it if that's short: name=value holds the value."""
    longest = max(word.split("="), key=len)
    return longest if len(longest) >= 16 else word


def occurrences(text: str, values: Iterable[str]) -> list[tuple[int, int]]:
    """Where the values stand, each leftmost and non-overlapping, by one pass over the text."""
    automaton, until, found = ahocorasick.Automaton(), {}, []
    for value in values:
        automaton.add_word(value, value)
    if not len(automaton):
        return found
    automaton.make_automaton()
    for last, value in automaton.iter(text):
        s, e = last + 1 - len(value), last + 1
        if s >= until.get(value, 0):
            until[value] = e
            found.append((s, e))
    return found


def not_within(copies: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The copies that lie in none of the others and in no longer copy."""
    kept, reach = [], 0
    for s, less, is_copy in sorted([(s, -e, False) for s, e in others] + [(s, -e, True) for s, e in copies]):
        if is_copy and -less > reach:
            kept.append((s, -less))
        reach = max(reach, -less)
    return kept


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that don't overlap a base span and are hard to compress, and all their copies.

    The values of base spans that are hard to compress have their copies reported too. All steps go along sorted
    spans or once over the text, so that the work grows with its length.
    """
    taken = sorted((s, e) for s, _, e in base)
    ends = list(accumulate((e for _, e in taken), max))
    starts = [s for s, _ in taken]
    overlaps = lambda s, e: (k := bisect_left(starts, e)) > 0 and ends[k - 1] > s
    spans, unsure = [], []  # both in the order of the text
    found = list(CANDIDATE.finditer(text))
    for m, sensitive in zip(found, in_context(text, found), strict=True):
        s, e = m.span()
        if overlaps(s, e) or not sensitive or not is_mixed(m.group()):
            continue
        (spans if is_novel(text, s, e, novelty) else unsure).append((s, e))
    unsure_starts, unsure_ends, open_ = [s for s, _ in unsure], [e for _, e in unsure], [True] * len(unsure)
    fresh = list(spans)
    while fresh:  # random strings nearby make a string look less novel: those reported are blanked out
        near = sorted({
            k for a, b in fresh for k in range(bisect_right(unsure_ends, a - SURROUNDING_CHARS), bisect_left(unsure_starts, b + SURROUNDING_CHARS)) if open_[k]
        })
        near = [k for k in near if is_novel(text, *unsure[k], novelty, spans)]
        fresh = [unsure[k] for k in near]
        for k in near:
            open_[k] = False
            insort(spans, unsure[k])
    values = {value_of(text[s:e]) for s, e in spans}
    spans += [tail.span(1) for _, e in spans if (tail := TAIL.match(text, e))]
    held: dict[str, list[tuple[int, int]]] = {}
    for s, kind, e in base:
        for m in CANDIDATE.finditer(text, BASE[0][1].match(text, s).start(2) if kind == 0 else s, e):
            if m.group() not in values and is_mixed(m.group()):
                held.setdefault(m.group(), []).append(m.span())
    times: dict[str, int] = {}
    for s, e in occurrences(text, held):
        times[text[s:e]] = times.get(text[s:e], 0) + 1
    values |= {value_of(word) for word, at in held.items() if times[word] > 1 and any(is_novel(text, *x, novelty) for x in at)}
    spans += not_within(occurrences(text, values), taken + spans)
    return [(s, len(BASE), e) for s, e in sorted(set(spans))]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs the spans of secrets in its whole text, as kind, start and end in code points.

    base: the base kinds' spans, joined by start and then kind; spans: with the novel ones. A sensitive word counts
    within 48 characters of a candidate or of one that adjoins it, and a candidate is compressed after the 512
    characters on either side. A null text is empty and has none; very long texts are scanned whole, in one pass for
    all copies. doc_id may be null or repeat. An empty table gives no rows; other columns of docs are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch), strict=True):
                base = base_spans(text)
                spans = base + novel_spans(text, base, novelty)
                kinds = [k for _, k, _ in spans]
                rows.append((doc_id, *map(kinds.count, range(len(KINDS))), joined(base), joined(spans)))
            yield common.batch_of(schema, *zip(*rows, strict=True))

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, {counts}, base string, spans string")


def redacted_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with mark in place of each run of spans that overlap."""
    parts, end = [], 0
    for s, _, e in sorted(spans):
        if s >= end:
            parts += [text[end:s], mark]
        end = max(end, e)
    return "".join([*parts, text[end:]]) if parts else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with mark in place of the secrets in text, and n_chars, if it is there, to match.

    A null text stays null.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            columns, texts = list(batch.columns), []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    text = redacted_text(text, base + novel_spans(text, base, novelty), mark)
                texts.append(text)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    found = common.mapped(docs, run, docs.schema)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
