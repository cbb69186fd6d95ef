"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Letters are words. Every test item is cut into windows of ten consecutive words (a shorter item is one
window), the windows enter one automaton over word numbers, and every text runs through it once. Hits are
word positions; they are mapped back to code points of the original text.

The test items are the query side: their words travel to the tasks in blocks of at most ``block_bytes``.
One block, the usual case, needs one scan of the texts and moves nothing. Of more blocks each has an automaton of its
own and a scan of its own, which writes hits only, by the digest of the text; hits of all blocks are joined to the
texts at the end, and no text is written. ``docs`` is read once per block and once more.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no window; an
item without an id marks words but is not counted; repeated items count once; an empty table on either
side gives no hits. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, alnum_words, remembered, set_aside
from lexframe.session import pin

WINDOW = 10
#: Two million bytes of items are some 350,000 windows, or a few million nodes.
BLOCK_BYTES = 2 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = "array<struct<start: bigint, end: bigint>>"


def automaton(items: list[tuple[str | None, bytes]], window: int):
    """(word -> number, automaton or None, per entry: its length and item ids, runs worth a scan)."""
    numbers: dict[bytes, int] = {}
    entries: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in alnum_words(text))
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            entries.setdefault(ids[at:at + window], set()).update([item_id] if item_id is not None else [])
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    values = []
    for number, (key, owners) in enumerate(entries.items()):
        machine.add_word(key, number)
        values.append((len(key), owners))
    if values:
        machine.make_automaton()
    # a word of no item leads back to the start, so only runs of known words can hold an entry
    runs = re.compile(b"\x01{%d,}" % min((length for length, _ in values), default=1))
    return numbers, machine if values else None, values, runs


def word_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Code point offsets, end exclusive, of runs of word positions."""
    found, spans = list(_WORD.finditer(text)), []
    at = seen = 0
    for first, last in runs:
        start = seen + len(text[at:found[first].start()].decode("utf-8", "replace"))
        at, seen = found[first].start(), start
        end = seen + len(text[at:found[last].end()].decode("utf-8", "replace"))
        at, seen = found[last].end(), end
        spans.append({"start": start, "end": end})
    return spans


def scan(text: bytes | None, earlier: list[tuple[int, int]], machinery):
    """Word count, merged runs of hit word positions, ids of the items that occur."""
    numbers, machine, values, known_runs = machinery
    words = alnum_words(text or b"")
    marked, owners = list(earlier), set()
    if machine is not None and words:
        for run in known_runs.finditer(bytes(map(numbers.__contains__, words))):
            first = run.start()
            for end, number in machine.iter(tuple(map(numbers.__getitem__, words[first:run.end()]))):
                length, ids = values[number]
                owners |= ids
                marked.append((first + end - length + 1, first + end))
    runs: list[tuple[int, int]] = []
    for first, last in sorted(marked):
        if runs and first <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return len(words), runs, owners


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    rows = items.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")
    ).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-2 * total // block_bytes) if total > block_bytes else 1)
    for number in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number)
        yield count, [(r["i"], r["t"].encode()) for r in part.collect()]


def _digest(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


def _scan_all(texts, earlier, owners, offsets: bool, machinery) -> list[list]:
    """Word counts, hit counts, item ids and spans: code points with ``offsets``, else first and last word."""
    n_words, n_hit, ids, spans = [], [], [], []
    for at, text in enumerate(texts):
        known = [(r["start"], r["end"]) for r in (earlier[at] if earlier else None) or ()]
        n, found, mine = scan(text, known, machinery)
        n_words.append(n)
        n_hit.append(sum(b - a + 1 for a, b in found))
        ids.append(sorted(mine | set((owners[at] if owners else None) or ())))
        spans.append(word_spans(text, found) if offsets and found else [{"start": a, "end": b} for a, b in found])
    return [n_words, n_hit, ids, spans]


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted), ``spans`` and ``contaminated``."""
    sc = docs.sparkSession.sparkContext
    ddl = f"n_words bigint, n_hit bigint, item_ids array<string>, spans {_SPANS}"
    hits = None
    for count, rows in _blocks(items, item_id, item_text, block_bytes):
        shared = sc.broadcast(rows)

        def make(shared=shared, last=count == 1, key=uuid.uuid4().hex):
            return lambda texts: _scan_all(
                texts, None, None, last, remembered(key, lambda: automaton(shared.value, window)))

        if count == 1:
            out = add_columns(docs, [text], ddl, make)
            break
        found = add_columns(docs.select(F.col(text).alias("__t")), ["__t"], ddl, make).where("n_hit > 0")
        found = pin(found.select(_digest("__t").alias("__key"), "item_ids", "spans").dropDuplicates(["__key"]),
                    "decontaminate")
        shared.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    else:
        by_text = hits.groupBy("__key").agg(
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("__ids"),
            F.flatten(F.collect_list("spans")).alias("__runs"),
        )
        joined = docs.withColumn("__key", _digest(text)).join(by_text, "__key", "left").drop("__key")

        def finish():
            return lambda texts, runs, ids: _scan_all(texts, runs, ids, True, ({}, None, [], None))

        out = add_columns(joined, [text, "__runs", "__ids"], ddl, finish).drop("__runs", "__ids")

    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no test window occurs, with their own columns."""
    rows, name, back = set_aside(docs)
    return back(find_items(rows, items, text=name[text], **options).where(~F.col("contaminated")))
