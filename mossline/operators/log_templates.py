"""Log entries from lines of differing layouts, by template mining.

Lines are tokenised into typed tokens: times, levels, names, numbers, bracketed groups, keys, and punctuation as it
stands. Each partition clusters its lines by the tokens up to the time, wherever it stands, and what is bracketed behind
it, and reduces a cluster to the longest common subsequence of its members: what all share is constant, what lies between
is a variable slot, and the first gap is where free text begins. Lines are compared whole, whatever their length. Templates
of all partitions are merged the same way. A slot is then classified by the types and values that it took: timestamp, level,
component, thread or number, message. The few templates that result go with the second pass, which reads entries by them.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mossline.runtime import cut, spread

ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]")
# Names of levels, also as single letters and as numbers.
LEVELS = (
    dict.fromkeys(("debug", "dbg", "trace", "verbose", "fine", "d", "10"), "DEBUG") | dict.fromkeys(("info", "information", "inf", "notice", "i", "20"), "INFO")
    | dict.fromkeys(("warn", "warning", "wrn", "w", "30"), "WARN") | dict.fromkeys(("error", "err", "severe", "e", "40"), "ERROR")
    | dict.fromkeys(("fatal", "critical", "crit", "alert", "emerg", "emergency", "panic", "f", "50"), "FATAL")
)
LEVEL_WORD = "|".join(sorted((w for w in LEVELS if len(w) > 2 and w.isalpha()), key=len, reverse=True))
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
# The notations of a time that a token can have, the more specific first.
TIMES = {
    "iso": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?",
    "plain": r"\d{4}[-/]\d\d[-/]\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?(?:Z|[+-]\d\d:?\d\d))?",
    "month": r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d(?:[.,]\d+)?",
    "letter": r"[A-Z]\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?",
    "clock": r"\d\d:\d\d:\d\d(?:[.,]\d+)?",
    "epoch": r"\d{13}|\d{10}(?:\.\d+)?",
}
NAME = r"[A-Za-z_][\w./-]*"
TOKEN = re.compile(
    "|".join(f"(?P<{k}>(?<![\\w.]){v}(?![\\w:]))" for k, v in TIMES.items())
    + rf"|(?P<group>\[[^\[\]\r\n]+\])|(?P<key>{NAME}=)|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<level>\b(?:{LEVEL_WORD})\b)|(?P<name>{NAME})|(?P<number>\d+(?:\.\d+)?)|(?P<blank>\s+)|(?P<other>.)",
    re.I | re.S,
)
TIME = re.compile("|".join(f"(?P<{k}>{v})" for k, v in TIMES.items()))
#: A line without this has no time; the same condition keeps lines from Python.
MAY_HAVE_TIME = r"\d\d:\d\d:\d\d|\d{10}"
HAS_TIME = re.compile(MAY_HAVE_TIME)
#: Bits of a table of common subsequences that are held at once; larger ones are halved, with the same length.
TABLE_BITS = 1 << 26
#: Signs in front of a line that mark it as quoted.
MARKS = (">", "|", "+", "-", "*", "#", "$")
GAP, SLOTS = "…", ("<name>", "<number>", "<level>", "<group>", "<string>")
ENDS_FIELD = ("|", ":", "-", "]", "<group>", "<level>", ">", ")")
#: Partitions' templates are first merged in so many groups for each cluster.
MERGE_BUCKETS = 512
#: More layouts than this are no layouts; they would go to every task.
MOST_LAYOUTS = 10_000


def clean(line: str) -> str:
    """A line without colour codes and without the carriage return of its end."""
    return ANSI.sub("", line).rstrip("\r\n")


def pairs_of_keys(line: str) -> list[tuple[str, str]] | None:
    """Keys and values of a line that is a JSON object or consists of key=value fields; else None."""
    if line.startswith("{"):
        try:
            found = json.loads(line)
        except ValueError:
            return None
        return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in found.items()] if isinstance(found, dict) else None
    if not re.match(rf"{NAME}=\S", line):
        return None
    fields, at = [], 0
    for m in re.finditer(rf"({NAME})=(\"(?:[^\"\\]|\\.)*\"|\S*)(?:\s+|$)", line):
        if m.start() != at:
            return None
        value = m.group(2)
        fields.append((m.group(1), unescaped(value[1:-1]) if value.startswith('"') and len(value) > 1 else value))
        at = m.end()
    return fields if at == len(line) and len(fields) > 1 else None


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/"}


def unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m.group(1)[1:], 16)) if len(m.group(1)) > 1 else ESCAPES.get(m.group(1), m.group(0)), text)


def token_stream(line: str) -> Iterator[tuple[str, str]]:
    """(symbol, text) of a line's tokens. Times, slots and blanks have symbols of their own, the rest is itself."""
    for m in TOKEN.finditer(line):
        kind, text = m.lastgroup, m.group()
        if kind in TIMES:
            yield f"<{kind}>", text
        elif kind == "group":
            inner = TIME.fullmatch(text[1:-1])
            yield f"[<{inner.lastgroup}>]" if inner else "[<level>]" if text[1:-1].strip().lower() in LEVELS and not text[1:-1].isdigit() else "[<number>]" if text[1:-1].isdigit() else "<group>", text
        elif kind in ("level", "name", "number", "string"):
            yield f"<{kind}>", text
        else:
            yield " " if kind == "blank" else text, text


def is_time(symbol: str) -> bool:
    return symbol.strip("[]<>") in TIMES and symbol.startswith(("<", "[<"))


def rows_of(a: tuple[str, ...], b: tuple[str, ...]) -> Iterator[int]:
    """For each beginning of `a`, a number whose bit j is 0 where b[: j + 1] has one more in common with it than b[:j]; gaps are equal to nothing."""
    places: dict[str, int] = defaultdict(int)
    for j, symbol in enumerate(b):
        if symbol != GAP:
            places[symbol] |= 1 << j
    row = every = (1 << len(b)) - 1
    for symbol in a:
        met = row & places.get(symbol, 0)
        row = ((row + met) | (row - met)) & every
        yield row


def in_common(row: int, n: int) -> list[int]:
    """How many symbols each beginning of n symbols, the empty one first, has in common by a row of `rows_of`."""
    return [0, *accumulate(int(bit == "0") for bit in reversed(f"{row:0{n}b}"))] if n else [0]


def matches(a: tuple[str, ...], b: tuple[str, ...]) -> list[tuple[int, int]]:
    """The positions in both of a longest common subsequence."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half, before, behind = len(a) // 2, 0, 0
        for before in rows_of(a[:half], b):
            pass
        for behind in rows_of(a[half:][::-1], b[::-1]):
            pass
        both = [x + y for x, y in zip(in_common(before, len(b)), reversed(in_common(behind, len(b))), strict=True)]
        at = both.index(max(both))
        return matches(a[:half], b[:at]) + [(half + i, at + j) for i, j in matches(a[half:], b[at:])]
    rows, found, i, j = [(1 << len(b)) - 1, *rows_of(a, b)], [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            found.append((i, j))
        else:
            i -= 1
    return found[::-1]


def common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """The longest common subsequence of two templates, of which what both begin and end with is part, with a gap wherever either has more."""
    least = min(len(a), len(b))
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == GAP), least)
    end = next((i for i in range(least - start) if a[-1 - i] != b[-1 - i] or a[-1 - i] == GAP), least - start)
    between = [(start + i, start + j) for i, j in matches(a[start : len(a) - end], b[start : len(b) - end])]
    out, i, j = list(a[:start]), start, start
    for x, y in between:
        out += [GAP, a[x]] if x > i or y > j else [a[x]]
        i, j = x + 1, y + 1
    if i < len(a) - end or j < len(b) - end:
        out.append(GAP)
    return (*out, *a[len(a) - end :])


@lru_cache(maxsize=1024)
def blocks(template: tuple[str, ...]) -> list[tuple[str, ...]]:
    """What stands between a template's gaps, before the first and behind the last."""
    ends = [i for i, symbol in enumerate(template) if symbol == GAP]
    return [template[i + 1 : j] for i, j in zip([-1, *ends], [*ends, len(template)], strict=True)]


def fits(template: tuple[str, ...], shape: tuple[str, ...]) -> bool:
    """Whether a shape has the template's constants in order and more only at its gaps."""
    first, *others = blocks(template)
    if not others:
        return shape == first
    *inner, last = others
    at, end = len(first), len(shape) - len(last)
    if at > end or shape[:at] != first or shape[end:] != last:
        return False
    for block in inner:
        while block:
            try:
                at = shape.index(block[0], at, end)
            except ValueError:
                return False
            if shape[at : at + len(block)] == block:
                break
            at += 1
        at += len(block)
    return at <= end


@dataclass
class Template:
    """A cluster: what all its lines share, how many they are, and of its slots and keys how many values had which property."""

    symbols: tuple[str, ...]
    count: int = 0
    values: dict[str, Counter] = field(default_factory=lambda: defaultdict(Counter))

    def add(self, symbols: tuple[str, ...], count: int) -> None:
        self.count += count
        if not fits(self.symbols, symbols):
            self.symbols = common(self.symbols, symbols)

    def see(self, slot: str, value: str) -> None:
        """Counts a value and which of the properties that tell slots apart it has: levels, whole numbers, ends in a digit, texts with blanks."""
        seen = self.values[slot]
        seen["all"] += 1
        if " " in value:
            seen["text"] += 1
        if value[-1:].isdecimal():
            seen["numbered"] += 1
        if value.isdecimal():
            seen["number"] += 1
        if is_level(value):
            seen["level"] += 1


def bracketed_end(symbols: list[str], end: int) -> int:
    """Where levels and bracketed groups that begin at `end` end, each with a blank before it at most."""
    while end < len(symbols):
        step = end + (symbols[end] == " ")
        if step < len(symbols) and symbols[step] in ("<group>", "<level>", "[<level>]", "[<number>]"):
            end = step + 1
        else:
            break
    return end


def free_before(symbols: tuple[str, ...]) -> bool:
    """Whether names or numbers stand before the time, other than the priority of a system log."""
    at = next(i for i, s in enumerate(symbols) if is_time(s))
    return any(s in ("<name>", "<number>") for s in symbols[3 if symbols[:3] == ("<", "<number>", ">") else 0 : at])


def head_of(line: str) -> tuple[tuple[str, ...], list[tuple[str, str]]] | None:
    """(cluster, tokens) of a line: its symbols up to the time with levels and bracketed groups right behind, and all its
    tokens. None for a line without a time, or that is marked or quotes before the time."""
    found = list(token_stream(line))
    symbols = [s for s, _ in found]
    at = next((i for i, s in enumerate(symbols) if is_time(s)), None)
    if at is None or "<string>" in symbols[:at] or symbols[0] == " " or (symbols[0] in MARKS and symbols[1] == " "):
        return None
    start = 3 if symbols[:3] == ["<", "<number>", ">"] else 0
    if ">" in symbols[start:at] or (symbols[at].strip("[]<>") == "epoch" and any(s in ("<name>", "<number>") for s in symbols[start:at])):
        return None
    return tuple(symbols[: bracketed_end(symbols, at + 1)]), found


def time_key(fields: list[tuple[str, str]]) -> str | None:
    """The key whose value is a time; a number counts only under a key that says so."""
    for k, v in fields:
        m = TIME.fullmatch(v)
        if m and (m.lastgroup != "epoch" or re.fullmatch(r"(?:@?time(?:stamp)?|ts|at|date|epoch|t)(?:_?ms)?", k, re.I)):
            return k
    return None


def mine(lines: Iterator[str]) -> dict[tuple, Template]:
    """The templates of lines, by cluster."""
    found: dict[tuple, Template] = {}
    for raw in lines:
        line = clean(raw)
        if not line or line[0].isspace():
            continue
        fields = pairs_of_keys(line)
        if fields is not None:
            timed = time_key(fields)
            if timed:
                keys = tuple(f"{k}=" for k, _ in fields)
                key = ("{" if line.startswith("{") else "=", timed)
                template = found.setdefault(key, Template(keys))
                template.add(keys, 1)
                for k, v in fields:
                    template.see(f"{k}=", v)
            continue
        got = head_of(line) if HAS_TIME.search(line) else None
        if got is None:
            continue
        key, tokens = got
        shape = tuple(s for s, _ in tokens)
        template = found.setdefault(key, Template(shape))
        template.add(shape, 1)
        constant = len(prefix(template.symbols))
        for i, (s, text) in enumerate(tokens[:constant]):
            if s in SLOTS or s in ("[<level>]", "[<number>]"):
                template.see(str(i), text)
        tail = next((i for i in range(len(key), min(len(shape) - 1, constant + 1)) if shape[i] == "<level>" and shape[i + 1] == ":"), None)
        if tail is not None:
            template.values["\0tail"][str(tail)] += 1
    return found


def eligible(key: tuple, template: Template) -> bool:
    """Whether a cluster is a layout: keys with a time, a time with nothing but punctuation, levels and brackets before it, or one
    behind names or numbers if several lines have it and all of them a level next to it, which no prose has."""
    if not any(is_time(s) for s in key) or not free_before(key):
        return True
    behind = str(len(key) + 1)
    named = len(template.symbols) > len(key) + 1 and template.symbols[len(key) + 1] == "<name>" and share(template.values.get(behind, Counter()), "level") > 0.9
    first = any(s == "<name>" and share(template.values.get(str(i), Counter()), "level") > 0.9 for i, s in enumerate(key))
    return template.count > 1 and (named or first or any(s in ("<level>", "[<level>]") for s in key))


def prefix(symbols: tuple[str, ...]) -> tuple[str, ...]:
    """The constant part before the first gap."""
    return symbols[: symbols.index(GAP)] if GAP in symbols else symbols


@dataclass(frozen=True)
class Layout:
    """How entries of one template are read: a pattern, or keys, and the part each slot plays. Several level keys are joined by NUL."""

    keyed: bool
    mark: str
    time: str
    level: str | None
    component: str | None
    message: str | None
    pattern: str = ""
    length: int = 0


def share(values: Counter, name: str) -> float:
    """The share of all values of a slot that have a property."""
    return values[name] / values["all"] if values["all"] else 0.0


def is_level(value: str) -> bool:
    return value.strip("[] ").lower() in LEVELS


# Names of keys, for slots that values alone don't tell apart.
COMPONENT_KEYS = ("component", "logger", "module", "source", "service", "subsystem", "tag", "program", "app", "name", "caller")
MESSAGE_KEYS = ("msg", "message", "text", "event", "log", "body")


def keyed_layout(mark: str, timed: str, template: Template) -> Layout:
    """Slots of key-value lines: the level by its values, message and component by their texts and then their names."""
    values = template.values
    others = [k[:-1] for k in values if not k.startswith("\0") and k[:-1] != timed]
    levels = [k for k in others if share(values[f"{k}="], "level") > 0.9]
    level = "\0".join(sorted(levels, key=lambda k: (k.lower() not in ("level", "lvl", "severity"), k))) or None
    rest = [k for k in others if k not in levels]
    spoken = {k: values[f"{k}="]["text"] / max(1, template.count) for k in rest}
    message = max(rest, key=lambda k: (k.lower() in MESSAGE_KEYS, spoken[k], k), default=None)
    names = [k for k in rest if k != message and spoken[k] < 0.5 and share(values[f"{k}="], "number") < 0.5]
    component = min(names, key=lambda k: (COMPONENT_KEYS.index(k.lower()) if k.lower() in COMPONENT_KEYS else len(COMPONENT_KEYS), k), default=None)
    return Layout(True, mark, timed, level, component, message)


def header(symbols: tuple[str, ...], key_length: int) -> int:
    """How many symbols of a template's constant part belong to the header: up to its last delimiter before free text.

    Where all lines have one shape there is no gap; free text then begins with two words that nothing but a blank parts.
    """
    own = prefix(symbols)
    end = key_length
    for i in range(key_length, len(own)):
        if own[i] in ENDS_FIELD and (i + 1 >= len(own) or own[i + 1] in (" ", "|") or own[i] == "|"):
            end = i + 1
        if own[i] == " " and own[i - 1] == "<name>" and own[i + 1 : i + 2] == ("<name>",) and GAP not in symbols and not any(s in ENDS_FIELD for s in own[i + 2 : i + 4]):
            break
        if own[i] == " " and i >= 2 and own[i - 1] in ("<name>", "<number>") and own[i - 2] == " " and own[i + 1 : i + 2] == ("<name>",) and key_length < i and "<level>" not in own[i:]:
            later = own[i:]
            if not any(s in ("|", ":", "-", "]") for s in later):
                break
    return end


SYMBOL_PATTERNS = {f"<{k}>": f"(?:{v})" for k, v in TIMES.items()} | {f"[<{k}>]": rf"\[(?:{v})\]" for k, v in TIMES.items()} | {
    "<name>": NAME, "<number>": r"\d+(?:\.\d+)?", "<level>": rf"(?i:{LEVEL_WORD})", "<string>": r"\"(?:[^\"\\]|\\.)*\"",
    "<group>": r"\[[^\[\]\r\n]+\]", "[<level>]": rf"\[\s*(?i:{LEVEL_WORD})\s*\]", "[<number>]": r"\[\d+\]", " ": r"\s+",
}


def positional_layouts(key: tuple[str, ...], template: Template) -> list[Layout]:
    """The pattern of a template's header and the parts of its slots; one more with a level behind it if that occurred."""
    n = header(template.symbols, len(key))
    own = template.symbols[:n]
    timed = next(i for i, s in enumerate(own) if is_time(s))
    level = component = None
    for i, s in enumerate(own):
        values = template.values.get(str(i), Counter())
        if level is None and i != timed and (s in ("<level>", "[<level>]") or (s == "<name>" and share(values, "level") > 0.9)):
            level = i
    names = [i for i, s in enumerate(own) if i > timed and i != level and s == "<name>"]
    groups = [i for i, s in enumerate(own) if i > timed and i != level and s == "<group>"]
    before = [i for i, s in enumerate(own) if i < timed and i != level and s == "<name>" and share(template.values.get(str(i), Counter()), "numbered") < 0.5]
    component = (names or groups or before or [None])[-1]
    parts = [f"(?P<p{i}>{SYMBOL_PATTERNS.get(s, re.escape(s))})" if i in (timed, level, component) else SYMBOL_PATTERNS.get(s, re.escape(s)) for i, s in enumerate(own)]
    named = {k: f"p{v}" if v is not None else None for k, v in (("time", timed), ("level", level), ("component", component))}
    if level is None and own[timed] == "<letter>":
        named["level"] = "letter"
    layouts = [Layout(False, "", message="rest", pattern="".join(parts), length=n, **named)]
    if named["level"] is None and template.values.get("\0tail", Counter())[str(len(prefix(template.symbols)))]:
        tail = rf"\s*(?P<tail>(?i:{LEVEL_WORD})):(?=\s|$)"
        layouts.append(Layout(False, "", message="rest", pattern="".join(parts) + tail, length=n + 2, **(named | {"level": "tail"})))
    return layouts


def layouts_of(templates: dict[tuple, Template]) -> list[Layout]:
    found: dict[tuple, Layout] = {}
    for key, template in sorted(templates.items(), key=lambda kv: (-kv[1].count, kv[0])):
        for layout in [keyed_layout(key[0], key[1], template)] if key[0] in ("{", "=") and len(key) == 2 and not is_time(key[1]) else positional_layouts(key, template):
            found.setdefault((layout.keyed, layout.mark, layout.time if layout.keyed else "", layout.pattern), layout)
    return sorted(found.values(), key=lambda x: (-x.length, x.level is None, x.pattern, x.time))


def merged(parts: list[tuple[str, str, int, str]]) -> dict[tuple, Template]:
    """Templates of several partitions (key, symbols, count, values as JSON) merged by their longest common subsequence."""
    out: dict[tuple, Template] = {}
    for key_text, symbols_text, count, values_text in sorted(parts):
        key, symbols = tuple(json.loads(key_text)), tuple(json.loads(symbols_text))
        template = out.setdefault(key, Template(symbols))
        template.add(symbols, count)
        for slot, values in json.loads(values_text).items():
            template.values[slot].update(values)
    return out


def packed(templates: dict[tuple, Template]) -> pd.DataFrame:
    """Templates as rows, with the values of slots before the first gap only."""
    rows = []
    for key, t in templates.items():
        constant = len(prefix(t.symbols))
        kept = {s: dict(v) for s, v in t.values.items() if not s.isdecimal() or int(s) < constant}
        rows.append((json.dumps(key), json.dumps(t.symbols), t.count, json.dumps(kept)))
    return pd.DataFrame(rows, columns=["key", "symbols", "n", "vals"])


def mined_templates(lines: DataFrame, message: str) -> dict[tuple, Template]:
    """The templates of all lines. Partitions are merged in two steps, so no task sees a row of each; the driver gets one row per layout, of a checked number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield packed(mine(line for batch in batches for line in batch["line"] if line))

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        return packed(merged(list(group[["key", "symbols", "n", "vals"]].itertuples(index=False, name=None))))

    schema = "key string, symbols string, n long, vals string"
    per_partition = lines.select(F.col(message).alias("line")).filter(F.col("line").rlike(MAY_HAVE_TIME)).mapInPandas(run, schema)
    some = per_partition.groupBy("key", F.pmod(F.spark_partition_id(), F.lit(MERGE_BUCKETS)).alias("bucket")).applyInPandas(reduce, schema)

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        rows = merged(list(group[["key", "symbols", "n", "vals"]].itertuples(index=False, name=None)))
        return packed({k: t for k, t in rows.items() if eligible(k, t)})

    few = some.groupBy("key").applyInPandas(settle, schema).limit(MOST_LAYOUTS + 1).collect()
    if len(few) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} layouts: the lines have a time but no layout")
    return merged([tuple(r) for r in few])


def seconds(kind: str, text: str) -> tuple[int | None, int, int | None]:
    """(days since 1970 in UTC or None, second of the day, month * 100 + day or None) of a time in any notation."""
    if kind == "epoch":
        whole = int(text[:10]) if len(text.split(".")[0]) == 13 or len(text) >= 10 else int(text)
        return whole // 86400, whole % 86400, None
    clock = re.search(r"(\d\d):(\d\d):(\d\d)", text)
    tod = int(clock[1]) * 3600 + int(clock[2]) * 60 + int(clock[3])
    if kind in ("iso", "plain"):
        y, mo, d = (int(x) for x in re.split(r"[-/]", text[:10]))
        day = days_from_civil(y, mo, d)
        zone = re.search(r"([+-])(\d\d):?(\d\d)$", text[19:])
        if zone:
            shift = (int(zone[2]) * 3600 + int(zone[3]) * 60) * (1 if zone[1] == "+" else -1)
            total = day * 86400 + tod - shift
            return total // 86400, total % 86400, None
        return day, tod, None
    if kind == "month":
        return None, tod, MONTHS[text[:3].title()] * 100 + int(text[4:6])
    if kind == "letter":
        return None, tod, int(text[1:5])
    return None, tod, None


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a date of the Gregorian calendar; an impossible day runs into the next month."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def first_line(text: str) -> str:
    return ANSI.sub("", re.split(r"\r\n|\r|\n", text, maxsplit=1)[0]).strip()


class Reader:
    """Reads lines by layouts: (day, second, month and day, level, component, head) of an entry's first line, else None."""

    def __init__(self, layouts: list[Layout]) -> None:
        self.keyed = {(x.mark, x.time): x for x in layouts if x.keyed}
        self.patterns = [(x, re.compile(x.pattern)) for x in layouts if not x.keyed]

    def read(self, raw: str):
        line = clean(raw)
        if not line or line[0].isspace():
            return None
        fields = pairs_of_keys(line) if self.keyed else None
        if fields is not None:
            layout = self.keyed.get(("{" if line[0] == "{" else "=", time_key(fields)))
            if layout is None:
                return None
            of = dict(fields)
            kind = TIME.fullmatch(of[layout.time])
            level = next((LEVELS.get(of[k].strip().lower(), "") for k in (layout.level or "").split("\0") if k in of), "")
            return (*seconds(kind.lastgroup, kind.group()), level, of.get(layout.component, "").strip() if layout.component else "", first_line(of.get(layout.message, "")) if layout.message else "")
        for layout, pattern in self.patterns:
            m = pattern.match(line)
            if not m:
                continue
            text = m.group(layout.time).strip("[]")
            kind = TIME.fullmatch(text).lastgroup
            level = text[0] if layout.level == "letter" else m.group(layout.level) if layout.level else ""
            component = m.group(layout.component).strip("[] ") if layout.component else ""
            return (*seconds(kind, text), LEVELS.get(level.strip("[] ").lower(), ""), component, first_line(line[m.end() :]))
        return None


#: Lines of one run that a window sees at once; a run of any length is cut into blocks of so many.
BLOCK_LINES = 20_000
ENTRY = "run_id {run}, line_no int, day int, tod int, md int, level string, component string, head string"


def log_entries(lines: DataFrame, runs: DataFrame, *, run: str = "run_id", number: str = "line_no", message: str = "message", started: str = "started_at", block_lines: int = BLOCK_LINES) -> DataFrame:
    """run_id, first_line, last_line, logged_at, level, component, head: one row per entry of each run.

    An entry begins at a line that starts, in its first column, with a time of day in one of the mined layouts, and ends
    before the next such line. Lines shipped twice count once. A time without a year gets the first year that isn't
    before the run's start, one without a date the day of the entry before it or, where the clock went back, the next
    day. Runs that `runs` lacks give logged_at only where a line has its full date. Null messages are lines without text;
    rows without run or number are dropped. A run may be of any length: all windows are over blocks of its lines.
    """
    rows = (
        lines.select(F.col(run).alias("run_id"), F.col(number).cast("int").alias("line_no"), F.col(message).alias("message"))
        .filter("run_id is not null and line_no is not null")
    )
    rows = spread(rows)
    layouts = layouts_of(mined_templates(rows, "message"))

    def run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(layouts)
        for batch in batches:
            out = []
            for run_id, line_no, text in zip(batch["run_id"], batch["line_no"], batch["message"], strict=True):
                got = reader.read(text) if text else None
                if got:
                    out.append((run_id, line_no, *got))
            yield pd.DataFrame(out, columns=["run_id", "line_no", "day", "tod", "md", "level", "component", "head"]).astype({"day": "Int32", "tod": "Int32", "md": "Int32"})

    schema = ENTRY.format(run=rows.schema["run_id"].dataType.simpleString())
    entries = cut(rows.filter(F.col("message").rlike(MAY_HAVE_TIME)).mapInPandas(run_batches, schema).dropDuplicates(["run_id", "line_no"]))
    begun = F.unix_timestamp(F.col(started).cast("timestamp"))
    starts = runs.select(F.col(run).alias("run_id"), begun.alias("began")).filter("run_id is not null").groupBy("run_id").agg(F.min("began").alias("began"))
    ends = rows.groupBy("run_id").agg(F.max("line_no").alias("end_line"))
    base = entries.join(starts, "run_id", "left").withColumn("block", F.floor(F.col("line_no") / block_lines))
    start_day, start_tod = F.floor(F.col("began") / 86400), F.pmod("began", 86400)
    dated = (
        base.withColumn("_this", F.expr("datediff(try_to_date(concat(year(timestamp_seconds(began)), '-', lpad(cast(floor(md / 100) as string), 2, '0'), '-', lpad(cast(pmod(md, 100) as string), 2, '0'))), date'1970-01-01')"))
        .withColumn("_next", F.expr("datediff(try_to_date(concat(year(timestamp_seconds(began)) + 1, '-', lpad(cast(floor(md / 100) as string), 2, '0'), '-', lpad(cast(pmod(md, 100) as string), 2, '0'))), date'1970-01-01')"))
        .withColumn("known", F.coalesce(F.col("day").cast("long"), F.when((F.col("_this") >= start_day), F.col("_this")).otherwise(F.coalesce("_next", "_this")).cast("long")))
    )
    ahead = Window.partitionBy("run_id").orderBy("block")
    edges = dated.groupBy("run_id", "block").agg(F.min_by("tod", "line_no").alias("first_tod"), F.max_by("tod", "line_no").alias("last_tod"), F.min("line_no").alias("block_first"))
    edges = edges.withColumn("tod_before", F.lag("last_tod").over(ahead)).withColumn("next_first", F.lead("block_first").over(ahead)).select("run_id", "block", "tod_before", "next_first")
    inside = Window.partitionBy("run_id", "block").orderBy("line_no")
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    turned = (
        dated.join(edges, ["run_id", "block"])
        .withColumn("_before", F.coalesce(F.lag("tod").over(inside), "tod_before", start_tod))
        .withColumn("turns", F.sum((F.col("tod") < F.col("_before")).cast("long")).over(up_to))
        .withColumn("anchor", F.last(F.col("known") - F.col("turns"), ignorenulls=True).over(up_to))
        .withColumn("next_line", F.coalesce(F.lead("line_no").over(inside), "next_first"))
    )
    per_block = turned.groupBy("run_id", "block").agg(F.max("turns").alias("_turns"), F.max_by("anchor", "line_no").alias("_anchor"))
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_block.withColumn("turns_before", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)))
        .withColumn("anchor_before", F.last(F.col("_anchor") - F.col("turns_before"), ignorenulls=True).over(earlier))
        .select("run_id", "block", "turns_before", "anchor_before")
    )
    day = F.coalesce(F.col("known"), F.col("anchor") + F.col("turns"), F.col("anchor_before") + F.col("turns_before") + F.col("turns"), start_day + F.col("turns_before") + F.col("turns"))
    return (
        turned.join(carried, ["run_id", "block"]).join(ends, "run_id")
        .select(
            F.col("run_id").alias(run), F.col("line_no").alias("first_line"), F.coalesce(F.col("next_line") - 1, F.col("end_line")).cast("int").alias("last_line"),
            F.date_format(F.timestamp_seconds(day * 86400 + F.col("tod")), "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "level", "component", "head",
        )
    )
