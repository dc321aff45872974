"""Per-document statistics of words, lines and symbols, and what they say a text is: prose or code, list, table or junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mossline.runtime import spread

LINE = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
MARK = re.compile(r"\s*(?:[-*+•‣⁃▪▫○●◦∙·‐-―→➤✓✔✗☐-☒]\s+|(?:[-*+]\s+)?\[[ xX✓]?\]\s+|\(?(?:\d{1,4}|[A-Za-z]|[ivxIVX]{1,6})[.):]\s+|#\d+[.:)]?\s+|\d{1,3}(?:\.\d{1,3})+\.?\s+|\(?[a-z]\)\s+)\S")
SENTENCE_END = re.compile(r"[.!?…。！？؟।][\"'”’»)\]`]*\s*$")
SENTENCE_IN = re.compile(r"(?<=[^\W\d_][\w`)'\"\]])[.!?؟।][\"'”’)`]*(?:\s+[^\Wa-z\d_]|$)|[。！？]")
AFTER_NUMBER = re.compile(r"\d\.(?:\s+[^\Wa-z\d_]|\s*$)")
SENTENCE_BREAK = re.compile(r"(?<=[.!?。！？؟।])\s+|(?<=[。！？])")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CODE_LINE = re.compile(
    r"\s*(?:(?:async\s+)?(?:def|class|for|while|with|if|elif|function|fn|func|struct|public|private|switch|case|match)\b.*[:{(]\s*(?:#.*)?$|(?:else|try|finally|except\b.*):\s*$|@\w[\w.]*(?:\(.*\))?\s*$|"
    r"(?:from\s+[\w.]+\s+)?import\s+[\w.*]|from\s+\.+\s*import\b|(?:return|raise|yield|assert|del|await|break|continue|pass)\b(?:\s+[\w.\[(\"'{-].*)?$|(?:const|let|var)\s+\w+\s*=|[\w.\[\]\"', *]+\s*[-+*/|&]?=\s*\S|"
    r"[\w.]+\(.*\)?[;:,]?\s*$|[)\]}]+[,;:]?\s*(?:->.*)?$|\w+\s*(?::\s*[\w\[\], |.]+)?(?:\s*=\s*\S+)?,\s*$|\w+:\s*[\w\[\]|.]+,?\s*$|\*{1,2}\w+,?$|#(?!\d)|\"\"\"|'''|[rRuUbBfF]?\"\"\".*|//|/\*|\*/|[+-]{3}\s|@@\s|[<>]{7})"
)
CODE_OPENING = re.compile(r"^\s*(?:(?:async\s+)?def\s+\w+\s*\(|class\s+\w+.*:\s*$|import\s+[\w.]+|from\s+[\w.]+\s+import\s|@\w+|#!/|(?:public|private|static)\s|function\s+\w+\s*\(|#include)", re.M)
HEX_LINE = re.compile(r"\s*(?:[0-9a-fA-F]{4,16}:?\s+)?(?:[0-9a-fA-F]{2,4}\s+){6,}.*$|\s*(?:\\x[0-9a-fA-F]{2}|0x[0-9a-fA-F]{2},?\s*){6,}.*$")
PAGE = re.compile(r"[-=<|~—\s]*(?:page|seite|página|pag|p\.)\s*[-#]?\d+(?:\s*(?:/|of|von|de|sur)\s*\d+)?[-=>|~—\s]*$|\s*[-–—]\s*\d+\s*[-–—]\s*$", re.I)
PROGRESS = re.compile(r"[\[(|][#=>.█░▒ -]{5,}[\])|]|\d\s?%.*(?:\d\s?(?:it|[kMG]i?B|B)/s|eta|[#=█]{3}|\||\d/\d)|(?:downloading|uploading|processing|loading|progress|fetching)\b.*\d\s?%", re.I)
# What links and notices around a page's text say.
NOTICES = ("cookie", "log in", "login", "sign up", "signup", "subscribe", "all rights reserved", "skip to content", "back to top", "share this", "copy link", "terms of use", "terms of service", "privacy policy", "copyright", "prev |", "| next", "« prev", "next »")
MOJIBAKE = re.compile(r"[ÂÃÅÐÑâãïð][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]|�|ï¿½")
IN_WORD_NOISE = re.compile(r"[^\W\d_][\\^%$~#*@|\[\];{}<>+=?!&]+(?=[^\W\d_])")
RUN = re.compile(r"(\S)\1{39,}")
GAP = re.compile(r"\S {2,}(?=\S)")
RULE_LINE = re.compile(r"[\s|+:=\-─-╿]+$")
AMPERSAND = re.compile(r"\s&\s")
MARKUP_ROW = re.compile(r"\s*(?:</?t(?:r|d|h|able|head|body)\b.*|\|\|.*\|\|\s*|\{\||\|[-}]|\|\}|\|-.*)", re.I)
UNSPACED = re.compile(r"[฀-໿က-႟ក-៿⺀-鿿가-힯豈-﫿＀-￯]")
# Frequent function words of the languages that the texts are mostly in.
COMMON = frozenset(
    "the of and to in a is that it for was on are as with they be at this from have or by not but what all were when we there can an your which if do how then so these would has more no way could than been who its now did get may part only just also into over after will about out up them one before had used "  # English
    "der die das und ist nicht ein eine einen dem den des mit auf für von zu im wir ich sich auch als an nach wie bei aus wird werden oder aber wenn nur noch um so dass es sie er hat haben war ob mehr über vor zum zur einem einer kann "  # German
    "le la les de des du un une et est en que qui dans pour pas ne sur avec par au aux ce cette il elle nous vous je se son sa ses plus mais ou si sont ont été être fait deux l d n s c qu j "  # French
    "el los las una y es en que por para con no se lo su sus al del un como más pero o si ya son está hay ha han muy sin sobre entre cuando desde todo esta este "  # Spanish
    "il di che è per non una sono con da lo gli le nel della dei al alla come anche ma più questo "  # Italian
    "o os as um uma em não com do da dos das no na por mais ao que foi ser "  # Portuguese
    "het een van en dat op te zijn met voor niet aan er ook als bij maar om uit ze wordt naar deze "  # Dutch
    "i w z na do nie się że jest to jak po co tak ale czy od za przez "  # Polish
    "и в не на что с по как это к из у за от для же но так о бы".split()  # Russian
)


class Stats(NamedTuple):
    n_chars: int
    n_words: int
    mean_word_len: float
    letter_ratio: float
    digit_ratio: float
    blank_ratio: float
    symbol_ratio: float
    n_lines: int
    mean_line_len: float
    end_punct_share: float
    sentence_share: float
    bullet_share: float
    short_share: float
    code_share: float
    common_share: float
    duplicate_line_share: float
    duplicate_paragraph_share: float
    duplicate_sentence_share: float
    top_ngram_share: float
    run_share: float
    longest_word: int
    long_word_share: float
    single_letter_share: float
    unspaced_share: float
    mojibake_share: float
    noise_share: float
    hex_share: float
    furniture_share: float
    table_share: float


WHOLE = {"n_chars", "n_words", "n_lines", "longest_word"}
COLUMNS = [(name, "bigint" if name in WHOLE else "double") for name in Stats._fields]


def has_notice(line: str) -> bool:
    lower = line.lower()
    return any(x in lower for x in NOTICES)


def is_furniture(line: str) -> bool:
    """Whether a line is a page number, a progress bar, or links and notices around a text; a long line, if most stretches of it are."""
    n = len(line)
    if n > 160:
        parts = [line[i : i + 90] for i in range(0, n, 90)]
        return 2 * sum(map(is_furniture, parts)) > len(parts)
    if "%" in line and PROGRESS.search(line):
        return True
    if PAGE.match(line):
        return True
    return has_notice(line) if n <= 90 else has_notice(line[: n // 2]) and has_notice(line[n // 2 :])


def is_sentence(line: str) -> bool:
    """Whether a line has the end of a sentence in it; a number before the stop counts unless it numbers the line."""
    if SENTENCE_IN.search(line):
        return True
    return "." in line and AFTER_NUMBER.search(line) is not None and not MARK.match(line)


def is_markup_row(line: str) -> bool:
    """Whether a line is a row of a table in HTML, LaTeX or wiki markup; takes time in proportion to its length."""
    bare = line.rstrip()
    return bare.endswith("\\\\") and AMPERSAND.search(bare[:-2]) is not None or MARKUP_ROW.fullmatch(line) is not None


def table_share(lines: list[str]) -> float:
    """The largest share of the lines that are rows with the same number of cells in one notation, apart from rules."""
    rows = [x for x in lines if not RULE_LINE.match(x)]
    if len(rows) < 2:
        return 0.0
    best, whole = 0.0, "\n".join(rows)
    for mark, least in (("|", 2), ("│", 2), ("┃", 2), ("║", 2), ("\t", 1), (",", 1), (";", 1), ("¦", 1), ("~", 2)):
        if mark not in whole:
            continue
        bare = [re.sub(r'"[^"]*"', '""', x) for x in rows] if mark in ",;" else rows
        counts = Counter(x.strip(" ").lstrip("\t").count(mark) if mark == "\t" else x.count(mark) for x in bare)
        n, times = max(((k, v) for k, v in counts.items() if k >= least), key=lambda kv: kv[1], default=(0, 0))
        if n and (mark not in ",;" or n >= 2 or not any(re.search(r"[,;]\s", x) for x in bare)):
            spaced = mark in ",;" and sum(f"{mark} " in x for x in bare) > 0.5 * len(bare)
            best = max(best, 0.0 if spaced and n < 3 else times / len(rows))
    if sum("  " in x.strip() for x in rows) > 0.5 * len(rows):
        starts = Counter(m.end() for x in rows for m in GAP.finditer(x.rstrip()))
        best = max(best, starts.most_common(1)[0][1] / len(rows) if starts else 0.0)
    return max(best, sum(map(is_markup_row, rows)) / len(rows))


def top_ngram_share(words: list[str], n_chars: int) -> float:
    """The largest share of characters that the occurrences of one run of 3 to 8 words cover."""
    best = 0.0
    for n in (3, 5, 8):
        if len(words) >= 3 * n:
            gram, times = Counter(zip(*(words[i:] for i in range(n)), strict=False)).most_common(1)[0]
            if times > 2:
                best = max(best, min(1.0, times * (sum(map(len, gram)) + n) / n_chars))
    return best


def statistics(text: str) -> Stats:
    n = len(text)
    all_lines = LINE.split(text)
    lines = [x for x in all_lines if x.strip()]
    k = max(1, len(lines))
    tokens = text.split()
    words = WORD.findall(text)
    lengths = list(map(len, tokens))
    visible = max(1, sum(lengths))
    letters = sum(map(len, words))
    digits = sum(map(len, DIGITS.findall(text)))
    longest = max(lengths, default=0)
    counted = Counter(x.strip() for x in lines)
    paragraphs = [p.strip() for p in re.split(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)", text) if p.strip()]
    sentences = [x.strip() for x in SENTENCE_BREAK.split(text) if x.strip()]
    return Stats(
        n_chars=n,
        n_words=len(words),
        mean_word_len=letters / max(1, len(words)),
        letter_ratio=letters / visible,
        digit_ratio=digits / visible,
        blank_ratio=(n - visible) / max(1, n),
        symbol_ratio=max(0.0, 1 - (letters + digits) / visible),
        n_lines=len(lines),
        mean_line_len=sum(len(x.strip()) for x in lines) / k,
        end_punct_share=sum(bool(SENTENCE_END.search(x)) for x in lines) / k,
        sentence_share=sum(map(is_sentence, lines)) / k,
        bullet_share=sum(bool(MARK.match(x)) for x in lines) / k,
        short_share=sum(len(x.strip()) <= 100 for x in lines) / k,
        code_share=sum(bool(CODE_LINE.match(x)) for x in lines) / k,
        common_share=sum(map(COMMON.__contains__, map(str.lower, words))) / max(1, len(words)),
        duplicate_line_share=1 - len(counted) / k,
        duplicate_paragraph_share=1 - len(set(paragraphs)) / max(1, len(paragraphs)),
        duplicate_sentence_share=1 - len(set(sentences)) / max(1, len(sentences)),
        top_ngram_share=top_ngram_share(tokens, max(1, n)),
        run_share=sum(m.end() - m.start() for t in tokens if len(t) >= 40 for m in RUN.finditer(t)) / visible if longest >= 40 else 0.0,
        longest_word=longest,
        long_word_share=sum(x for x in lengths if x > 60) / visible if longest > 60 else 0.0,
        single_letter_share=sum(t.isalpha() for t in tokens if len(t) == 1) / len(tokens) if 1 in lengths else 0.0,
        unspaced_share=len(UNSPACED.findall(text)) / visible,
        mojibake_share=len(MOJIBAKE.findall(text)) / visible,
        noise_share=len(IN_WORD_NOISE.findall(text)) / max(1, len(tokens)),
        hex_share=sum(bool(HEX_LINE.match(x)) for x in lines) / k,
        furniture_share=sum(map(is_furniture, lines)) / k,
        table_share=table_share(lines),
    )


def kind_of(s: Stats, text: str) -> str:
    """'list', 'table', 'junk', or '' for prose, code and blank texts."""
    if not s.n_lines:
        return ""
    spaced = s.unspaced_share < 0.3
    if s.mojibake_share > 0.01 and s.n_chars > 20:
        return "junk"
    if s.run_share > 0.5 or s.hex_share > 0.7:
        return "junk"
    if s.n_lines >= 3 and s.furniture_share > 0.7:
        return "junk"
    if s.n_lines >= 4 and max(s.duplicate_line_share, s.duplicate_paragraph_share) > 0.6:
        return "junk"
    if s.n_lines >= 3 and s.table_share >= 0.75 and s.code_share < 0.6 and s.end_punct_share < 0.5:
        return "table"
    if (s.top_ngram_share > 0.6 and s.bullet_share < 0.5) or (s.n_chars > 200 and s.duplicate_sentence_share > 0.6):
        return "junk"
    if spaced and s.single_letter_share > 0.6 and s.n_words > 10:
        return "junk"
    code = s.code_share > 0.5 or (s.code_share > 0.3 and CODE_OPENING.search(text) is not None)
    if spaced and s.n_chars > 40 and s.long_word_share > 0.6 and not (s.n_lines >= 4 and s.mean_line_len < 100):
        return "junk"
    if s.n_chars > 20 and s.letter_ratio < 0.3 and s.bullet_share < 0.5:
        return "junk"
    if s.noise_share > 0.25 and not code and s.bullet_share < 0.5:
        return "junk"
    if spaced and s.n_words >= 20 and s.common_share < 0.02 and s.noise_share > 0.08 and not code:
        return "junk"
    if code:
        return ""
    if s.n_lines >= 3 and s.bullet_share >= 0.75 and s.sentence_share < 0.5:
        return "list"
    if s.n_lines >= 4 and s.mean_line_len <= 48 and s.short_share > 0.95 and s.sentence_share < 0.12:
        return "list"
    return ""


def quality(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, one column per statistic, kind: one row per document; null and blank texts have zeros and the kind ''.

    Whole texts are read. Shares of lines count lines that aren't blank; ratios are of visible characters.
    """
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            stats = [statistics(t or "") for t in texts]
            kinds = [kind_of(s, t) if t else "" for s, t in zip(stats, texts, strict=True)]
            columns = [pa.array([s[i] for s in stats], pa.int64() if kind == "bigint" else pa.float64()) for i, (_, kind) in enumerate(COLUMNS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(kinds, pa.string())], ["key", *[c for c, _ in COLUMNS], "kind"])

    schema = ", ".join([f"key {rows.schema['key'].dataType.simpleString()}", *[f"{c} {t}" for c, t in COLUMNS], "kind string"])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
