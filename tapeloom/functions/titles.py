"""M1 to M4: names of series, channel numbers and start times, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The counters that number an episode, as programme listings use them.
COUNTERS = "話回幕夜章篇編部怪番"
#: Longest square-bracket mark, and longest angle-bracket label at the front and at the end, in characters.
MARK, BLOCK, LABEL = 8, 24, 25

_DIGIT = "[0-9０-９]"
_ONE = rf"(?:{_DIGIT}+|[〇零一二三四五六七八九十百]+|最終)"
_NUMBER = rf"{_ONE}(?:[-~－～〜・、]{_ONE})?"
_EPISODE = (
    rf"(?:[#＃]{_DIGIT}|第{_NUMBER}[{COUNTERS}]|{_NUMBER}話"
    rf"|[(（]{_DIGIT}+[)）]|(?<![A-Za-zＡ-Ｚａ-ｚ])(?i:ep|episode|ｅｐ|ｅｐｉｓｏｄｅ)[.．\s　]*{_DIGIT})"
)
_EDGE = r"[\s　・▼]"
_WORD = r"[\p{L}\p{N}]"


def tidy(name: Column) -> Column:
    return F.regexp_replace(name, rf"^{_EDGE}+|{_EDGE}+$", "")


def fold_width(name: Column) -> Column:
    """Full-width ASCII and the wide space as ASCII, in lower case; one character for one."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    return F.lower(F.translate(name, wide, "".join(chr(0x21 + i) for i in range(94)) + " "))


def series_title(name: Column) -> Column:
    """M1: the series' name out of a recording's: marks, block labels, everything from the episode on, and labels at the end go.

    A name with no episode loses a final quoted title instead. What would come out empty is the
    tidied name itself.
    """
    square = rf"[\[［][^\]］]{{0,{MARK}}}[\]］]"
    thick = rf"(?:(?<!{_WORD})【[^】]*】|【[^】]{{0,2}}】|【[^】]*】(?!{_WORD})|【[^】]*】(?={_EPISODE})|【[^】]*{_EPISODE}[^】]*】)"
    text = F.regexp_replace(name, rf"([\s　]?)(?:{square}|{thick})(?:(?<=[\]］】])[\s　]+(?=[^\s　])(?<=[\s　]))?", "$1")
    text = F.regexp_replace(text, r"([\s　])[\s　]+", "$1")
    block = rf"^(?:{_EDGE}*(?:[<＜][^>＞]{{0,{BLOCK}}}[>＞]|アニメ[A-Za-zＡ-Ｚａ-ｚ]?[\s　・]))*{_EDGE}*"
    text = F.regexp_replace(text, block, "")
    cut = F.regexp_replace(text, rf"(?s){_EPISODE}.*$", "")
    text = F.when(cut == text, F.regexp_replace(text, r"「[^「」]*」[\s　]*$", "")).otherwise(cut)
    text = tidy(F.regexp_replace(tidy(text), rf"(?<=.)(?:{_EDGE}*[<＜][^<>＜＞]{{0,{LABEL}}}[>＞]{_EDGE}*)+$", ""))
    return F.when(text == "", tidy(name)).otherwise(text)


def without_bare_number(name: Column) -> Column:
    """M2: the name with a number at its end cut off."""
    return tidy(F.regexp_replace(name, rf"{_DIGIT}+{_EDGE}*$", ""))


def channel_number(service: Column, button: Column) -> Column:
    """M3: three-digit services are their own number; larger ones follow their button; else 0."""
    return F.when(service.between(100, 999), service).when((service >= 1000) & button.isNotNull(), button * 10 + service.bitwiseAND(7) + 1).otherwise(0)


def parse_began(text: Column) -> Column:
    """M4: `Y-M-D h:m[:s]` as a struct of whole numbers, NULL out of range; the day is at most 31, whatever the month."""
    parts = F.split(F.regexp_replace(F.trim(text), r"[-: ]+", " "), " ")
    ok = F.trim(text).rlike(r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$")
    n = [F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(6)]
    fits = n[1].between(1, 12) & n[2].between(1, 31) & (n[3] < 24) & (n[4] < 60) & (n[5] < 60)
    return F.when(ok & fits, F.struct(*[x.alias(c) for x, c in zip(n, ("year", "month", "day", "hour", "minute", "second"), strict=True)]))
