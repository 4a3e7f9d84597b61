"""Text cut off by field limits: corpus vocabulary trie, length evidence, end-of-text structure.

Every distinct text is read once, whole, which gives two things. *Facts* are counts over all distinct texts, so that copies of
one text do not vouch for how it ends: words (without each text's last token), words that end a list item inside a text,
lengths of such items, shapes of tokens before a full stop inside a text, and closing lines with one or two words masked.
*Tails* describe how each text ends. The verdict on a text:

* cut, if its last token is an unknown proper prefix of known words (trie), unless a sentence mark follows it;
* cut, if what it has begun is open: a code block, a table row, a list item unlike others, a line that is neither a sentence
  nor a closing line that many texts share nor a sign-off (structure). Whether a list item of usual length is open depends on
  the field limit of its source too (length); for all other ends a text at the limit is cut by structure alike, and the length
  is named as evidence;
* whole otherwise.

The trie is a distributed table of words under their prefixes of up to ``TRIE_CHARS`` characters, joined to the last tokens
and compared in full; it is never collected or broadcast.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage

#: Texts up to this many characters are no cases.
LEAST_CHARS = 10
#: Share of the distinct texts that must end in a closing line for it to count as one, and the least number of texts.
CLOSER_SHARE, CLOSER_LEAST = 0.001, 3
#: Share of all full stops inside texts that must follow a token shape for it to be one.
SHAPE_SHARE = 0.0002
#: Share of the unpunctuated list items inside texts that must have as many words as an item for it to be of usual length,
#: beside at least as many without a mark at their end as with one.
ITEM_SHARE = 0.005
#: A word is known from this many occurrences on.
KNOWN = 3
#: Levels of the trie that are a row each; below, the few words under one prefix are compared.
TRIE_CHARS = 8
#: A length is a field limit of a source when this share of its texts (and LIMIT_LEAST of them) has exactly it.
LIMIT_SHARE, LIMIT_LEAST = 0.03, 5

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\w+")
_TRACE = re.compile(r"(\[\s*(truncated|cut|snip|snipped|more|continued|\.\.\.|…)\s*\]|\(\s*(more|continued|truncated|cut|\.\.\.|…)\s*\)|<\s*(cut|snip|truncated)\s*>|�+)$", re.I)
_ELLIPSIS = re.compile(r"(\.\.\.+|…)$")
_SENTENCE = re.compile(r"[.!?。！？]['\"”’»)\]*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(.*)$")
_BARE_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])$")
_PLAIN_STOP = re.compile(r"[^\W\d_]{3,}\.")
_GREETING = re.compile(r"[A-ZÀ-Þ][^.!?:;|`#]*,$")
_NAME = re.compile(r"(?:[-–—~]+\s*)?(?:[A-ZÀ-Þ][\w'’-]*\.?(?:\s+|$)){1,5}")
_FENCE = re.compile(r"^\s*(```+|~~~+)", re.M)
_BLOCK = re.compile(r"^\s*(```|~~~).*?(?:^\s*\1[^\n]*$|\Z)", re.M | re.S)


def token_shape(token: str) -> str:
    """Runs of small letters as a, capitals as A, digits as 9, everything else as it is."""
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_a-zß-ÿA-Z]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[a-zß-ÿ]+", "a", token))))


#: Shapes of tokens seen lately; most full stops follow one of few words.
_shape = lru_cache(maxsize=50_000)(token_shape)


def closing_keys(line: str) -> list[str]:
    """The line in lower case with digits as 9, as it is and with each word and each pair of neighbours masked, as hashes.

    A key whose last word is masked ends in ``\x02`` and that word, so that its fillers can be told apart. Each half of a
    masked line is hashed as it grows, so a line of any length costs one pass.
    """
    line = re.sub(r"\d+", "9", line.strip().lower())
    words = list(_TOKEN.finditer(line))
    if not words:
        return []
    before, after = [0] * (len(words) + 1), [0] * (len(words) + 1)
    edges = [0, *(w.end() for w in words)]
    for i, w in enumerate(words):  # hash of everything up to the beginning of word i + 1, and of its own gap
        before[i + 1] = xxhash.xxh64_intdigest(line[edges[i] : w.end()], before[i])
    after[-1] = xxhash.xxh64_intdigest(line[edges[-1] :])
    for i in range(len(words) - 1, -1, -1):
        after[i] = xxhash.xxh64_intdigest(line[edges[i] : edges[i + 1]], after[i + 1])
    keys = [f"{after[0]:016x}"]
    for size in (1, 2):
        for i in range(len(words) - size + 1) if len(words) > size else ():
            gaps = "\x01".join(line[edges[k] : words[k].start()] for k in range(i, i + size))
            key = f"{xxhash.xxh64_intdigest(f'{before[i]} {size} {gaps} {after[i + size]}'):016x}"
            if i + size < len(words):
                keys.append(key)
            elif "9" not in words[-1].group(0):
                keys.append(key + "\x02" + words[-1].group(0))
    return keys


def is_sign_off(lines: list[str]) -> bool:
    """Whether the last line is a name, of up to five capitalised words, under a short greeting that ends in a comma."""
    above = next((x.strip() for x in reversed(lines[:-1]) if x.strip()), "")
    return bool(_GREETING.match(above) and len(above.split()) <= 5 and _NAME.fullmatch(lines[-1].strip()))


def _table_verdict(lines: list[str]) -> str:
    rows = []
    for line in reversed(lines):
        if not line.lstrip().startswith("|"):
            break
        rows.append(line.strip())
    rows.reverse()
    cells = [r.count("|") for r in rows]
    if not rows[-1].endswith("|") or len(rows) < 3 or cells[-1] != cells[0] or re.fullmatch(r"[|:\-\s]+", rows[-1]):
        return "cut"
    return "whole"


def tail_of(text: str) -> tuple[str, str, str, list[str]]:
    """(verdict, kind, last token, keys): verdict whole or cut where the end alone tells, else ask with what to look up."""
    body = text.rstrip()
    lines = body.split("\n")
    last = lines[-1].strip()
    word = _WORD.search(last[::-1])
    token = word.group(0)[::-1].lower() if word and word.start() == 0 else ""
    if len(_FENCE.findall(body)) % 2 or re.fullmatch(r"`{1,2}|~{1,2}", last):
        return "cut", "open code block", token, []
    if _TRACE.search(last):
        return "cut", "trace", token, []
    if _FENCE.match(last):
        return "whole", "code block", token, []
    if last.startswith("|"):
        return _table_verdict(lines), "table row", token, []
    if _ELLIPSIS.search(last):
        return "ask", "ellipsis", "", closing_keys(last)
    if last.count("`") % 2:
        return "cut", "open code span", token, []
    item = _ITEM.match(lines[-1])
    if not (item and item.group(1).strip() != last.lstrip("-–—~ ")) and is_sign_off(lines):
        return "ask", "sign-off", token, []
    if _SENTENCE.search(last):
        spoken = last.split()[-1].rstrip("'\"”’»)]*_`")
        plain = not spoken.endswith(".") or _PLAIN_STOP.fullmatch(spoken)
        return ("whole", "sentence", "", []) if plain else ("ask", "full stop", "", [token_shape(spoken)])
    if item or _BARE_ITEM.match(last):
        words = item.group(1).split() if item else []
        before = _item_before(lines)
        if not words or _SENTENCE.search(before.strip()) or last[-1] in ",;:-–—(":
            return "cut", "list item", token, []
        if before and len(before.split()) > len(words):
            return "cut", "list item", token, []
        return "ask", "list item", token, [str(len(words))]
    if last.startswith("#"):
        return "cut", "heading", token, []
    keys = closing_keys(last)
    return ("ask", "closing line", token, keys) if keys else ("cut", "sentence", token, [])


def _item_before(lines: list[str]) -> str:
    """Text of the item before the last one of the same list; blank and indented lines may stand between."""
    for line in reversed(lines[:-1]):
        item = _ITEM.match(line)
        if item:
            return item.group(1)
        if line.strip() and not line[0].isspace():
            return ""
    return ""


def facts_of(text: str, counts: dict[str, Counter]) -> None:
    """Add what the text tells to the counts of each kind of fact."""
    body = text.rstrip()
    words = _WORD.findall(body.lower())
    if words and body[-1:].isalpha():
        words.pop()
    counts["word"].update(words)
    prose = _BLOCK.sub("", body)
    tokens = prose.split()
    counts["stop"].update(_shape(t) for t in tokens[:-1] if t.endswith("."))
    lines = prose.split("\n")
    for line in lines[:-1]:
        item = _ITEM.match(line)
        if not item:
            continue
        length, tail = str(len(item.group(1).split())), _WORD.findall(item.group(1))
        if _SENTENCE.search(item.group(1).rstrip()):
            counts["itemdot"][length] += 1
        elif tail:
            counts["item"][tail[-1].lower()] += 1
            counts["itemlen"][length] += 1


_READ = "h1 bigint, h2 bigint, verdict string, kind string, token string, keys array<string>, fact string, key string, n bigint"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per text on how it ends, and a row per fact of the batch; one pass."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        tails = []
        for h1, h2, text in zip(batch["h1"], batch["h2"], batch["text"], strict=True):
            counts["text"][""] += 1
            facts_of(text, counts)
            tails.append((h1, h2, *tail_of(text)))
            if tails[-1][2] == "ask" and tails[-1][3] in ("ellipsis", "closing line"):
                counts["closer"].update(set(tails[-1][5]))
        if tails:
            yield pd.DataFrame(tails, columns=["h1", "h2", "verdict", "kind", "token", "keys"]).assign(fact=None, key=None, n=pd.NA).astype({"n": "Int64"})
            facts = pd.concat([pd.DataFrame({"fact": kind, "key": list(own), "n": list(own.values())}) for kind, own in counts.items()], ignore_index=True)
            yield facts.assign(h1=pd.NA, h2=pd.NA, verdict=None, kind=None, token=None, keys=None).astype({"h1": "Int64", "h2": "Int64", "n": "Int64"})


def judge_ends(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_chars, kind, evidence, is_cut) for every document with a text of more than LEAST_CHARS characters.

    Null, empty and very short texts give no row; a null source is a source of its own. Repeated rows and equal texts are
    judged alike. Extra columns are ignored. An empty table gives an empty result.
    """
    body = F.rtrim(F.col(text))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.length(text).cast("bigint").alias("n_chars")).where(F.length(body) > LEAST_CHARS)
    docs = docs.withColumns({f"h{i}": F.xxhash64(F.lit(i), "text") for i in (1, 2)})
    distinct = docs.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    read = cut_lineage(distinct.mapInPandas(_read, _READ))
    facts = cut_lineage(read.where("fact is not null").groupBy(F.col("fact").alias("kind"), "key").agg(F.sum("n").alias("n")))
    ends = read.where("fact is null").select("h1", "h2", "verdict", "kind", "token", "keys")
    places = cut_lineage(docs.select("doc_id", "source", "n_chars", "h1", "h2", F.coalesce("source", F.lit("\x00")).alias("place")))

    lengths = places.groupBy("place", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    totals = lengths.groupBy("place").agg(F.sum("n").alias("of"))
    limits = lengths.join(totals, "place").where((F.col("n") >= LIMIT_LEAST) & (F.col("n") >= LIMIT_SHARE * F.col("of"))).groupBy("place").agg(F.max("n_chars").alias("field_limit"))

    total_texts, stops, items_seen = facts.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in ("text", "stop", "itemlen")]).first()
    # a masked last word is a slot only if no single filler makes up half of it
    lines = facts.where("kind = 'closer'").groupBy("kind", F.substring_index("key", "\x02", 1).alias("key")).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.bool_or(F.instr("key", "\x02") > 0).alias("slot"))
    closers = lines.where((F.col("n") >= max(CLOSER_LEAST, CLOSER_SHARE * total_texts)) & (~F.col("slot") | (2 * F.col("top") <= F.col("n")))).select("kind", "key", "n")
    # an item may end without a mark if those of its length mostly do
    by_length = facts.where(F.col("kind").isin("itemlen", "itemdot")).groupBy("key").agg(F.sum(F.when(F.col("kind") == "itemlen", F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("kind") == "itemdot", F.col("n")).otherwise(0)).alias("dotted"))
    lengths_seen = by_length.where((F.col("n") >= ITEM_SHARE * items_seen) & (F.col("n") >= F.col("dotted"))).select(F.lit("itemlen").alias("kind"), "key", "n")
    shapes = facts.where((F.col("kind") == "stop") & (F.col("n") >= SHAPE_SHARE * stops))

    # the look-ups are made per distinct text that asks for them
    asked = ends.where("verdict = 'ask'")
    looked = asked.select("h1", "h2", F.explode(F.transform("keys", lambda k: F.substring_index(k, "\x02", 1))).alias("key"), F.when(F.col("kind") == "full stop", "stop").when(F.col("kind") == "list item", "itemlen").otherwise("closer").alias("fact"))
    good = shapes.unionByName(closers).unionByName(lengths_seen).select(F.col("kind").alias("fact"), "key")
    shared = join_split_hot(looked, good, ["fact", "key"], "left_semi").select("h1", "h2").distinct().withColumn("shared", F.lit(True))

    tokens = asked.where("token != ''").select("token").distinct()
    words = facts.where((F.col("kind") == "word") & (F.col("n") >= KNOWN)).select(F.col("key").alias("word"), "n")
    nodes = words.select("word", F.explode(F.expr(f"transform(sequence(1, least(length(word), {TRIE_CHARS})), i -> substring(word, 1, i))")).alias("node"))
    under = tokens.withColumn("node", F.substring("token", 1, TRIE_CHARS)).join(nodes, "node").where(F.col("word").startswith(F.col("token")) & (F.col("word") != F.col("token")))
    trie = under.groupBy("token").agg(F.count(F.lit(1)).alias("n_longer"))
    items = facts.where("kind = 'item'").select(F.col("key").alias("token"), F.col("n").alias("n_items"))
    known = tokens.join(trie, "token", "left").join(words.select(F.col("word").alias("token"), F.col("n").alias("n_word")), "token", "left").join(items, "token", "left").na.fill(0)

    judged = join_split_hot(asked.drop("keys").join(shared, ["h1", "h2"], "left"), known, "token", "left")
    looks = judged.select(
        "h1",
        "h2",
        "verdict",
        "kind",
        F.coalesce("shared", F.lit(False)).alias("shared"),
        ((F.coalesce("n_word", F.lit(0)) == 0) & (F.coalesce("n_longer", F.lit(0)) > 0)).alias("part_of_word"),
        ((F.coalesce("n_items", F.lit(0)) > 0) & (F.coalesce("n_items", F.lit(0)) >= 0.001 * F.coalesce("n_word", F.lit(0)))).alias("ends_items"),
        (F.coalesce("n_word", F.lit(0)) > 0).alias("known_word"),
    )
    plain = ends.where("verdict != 'ask'").select("h1", "h2", "verdict", "kind", *[F.lit(False).alias(c) for c in ("shared", "part_of_word", "ends_items", "known_word")])
    full = join_split_hot(places, looks.unionByName(plain), ["h1", "h2"], "inner")
    full = join_split_hot(full, limits, "place", "left")
    at_limit = F.coalesce((F.col("field_limit") - F.col("n_chars")).between(0, 2), F.lit(False))
    usual = F.col("shared") | F.lit(items_seen == 0)
    no_item = ~usual | (~F.col("ends_items") & (at_limit | F.col("known_word")))
    open_end = (
        F.when(F.col("verdict") == "cut", True)
        .when(F.col("verdict") == "whole", False)
        .when(F.col("kind") == "list item", no_item)
        .when(F.col("kind") == "sign-off", F.lit(False))
        .otherwise(~F.col("shared"))
    )
    unfinished = (F.col("verdict") == "ask") & F.col("kind").isin("list item", "sign-off", "closing line") & F.col("part_of_word")
    cut = unfinished | open_end
    evidence = F.when(F.coalesce("part_of_word", F.lit(False)), F.lit("unfinished word")).when(at_limit, F.lit("field limit")).otherwise(F.col("kind"))
    return full.select("doc_id", "source", "n_chars", "kind", evidence.alias("evidence"), F.coalesce(cut, F.lit(False)).alias("is_cut"))


def truncation_report(judged: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_share, at most common length): how often each source truncates."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_cut").alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("int")), 6).alias("cut_share"), F.max(F.when(F.col("is_cut"), F.col("n_chars"))).alias("longest_cut"))
