"""Text columns: diacritics, tokens, white space, stems. Row-local; nothing here shuffles but the vocabulary of stems."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from actmill.functions.stemmer import stem

# Function words that tell no two articles apart, without diacritics.
STOPWORDS = """
a acea aceasta aceea acel acela acest acesta aceste acestea acestei acestor acestui
ai al ale alt alte altor am ar are as asa asupra au avea ca care cat ce cea cei cel
cele celor ci cu cum da daca de decat deci din dintre e ei el ele este eu fara fi
fie fiecare fost i ia ii il in inca incat insa intr intre isi iar la le li lor lui
ma mai mi ne nici nu o ori pe pentru prin sa sau se si sunt spre sub sus ta te tu
un una unei unor unui va vor
""".split()
#: The standard's range of Hangul syllables.
FIRST_SYLLABLE, LAST_SYLLABLE = 0xAC00, 0xD7A3
# A token is a word, or two joined by a caret.
TOKEN = r"[\p{L}\p{N}_]+(?:\^[\p{L}\p{N}_]+)?"


@cache
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition without combining characters does to each character, as Unicode's tables have it.

    (characters that change to one, those they change to followed by nothing for characters that go, a pattern class of
    characters that change to several, and these). Syllables of Hangul are many and follow a rule: they are in the class
    only. Each character is on its own, since only combining characters are ever reordered.
    """
    single, gone, several = {}, [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if len(plain) == 1:
            single[c] = plain
        elif plain:
            several[c] = plain
        else:
            gone.append(c)
    codes = sorted(map(ord, several))
    starts = [x for x in codes if chr(x - 1) not in several]
    ends = [x for x in codes if chr(x + 1) not in several]
    kinds = r"[\x{80}-\x{10FFFF}&&[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in zip(starts, ends, strict=True)) + "]]"  # the first range settles ASCII at once
    return "".join(single) + "".join(gone), "".join(single.values()), kinds, {c: d for c, d in several.items() if not FIRST_SYLLABLE <= ord(c) <= LAST_SYLLABLE}


def _jamo(code: Column) -> Column:
    """A syllable's two or three letters, by the arithmetic of the standard."""
    at = code - FIRST_SYLLABLE
    unit = lambda first, n: F.decode(F.unhex(F.lpad(F.hex((F.lit(first) + n).cast("int")), 4, "0")), "UTF-16BE")
    tail = at % 28
    return F.concat(unit(0x1100, F.floor(at / 588)), unit(0x1161, F.floor(at % 588 / 28)), F.when(tail > 0, unit(0x11A7, tail)).otherwise(""))


def strip_diacritics(c: Column) -> Column:
    """Compatibility decomposition without combining characters, for a column or its name.

    Characters that change to one other, or go, are one translate(); of those that change to several, each that the text
    has is replaced by itself. ASCII texts are left as they are.
    """
    c = F.col(c) if isinstance(c, str) else c
    changed, to, kinds, several = _decompositions()
    known = F.from_json(F.lit(json.dumps(several)), "map<string, string>")
    code = lambda x: F.ascii(x)
    several_of = lambda x: F.when(code(x).between(FIRST_SYLLABLE, LAST_SYLLABLE), _jamo(code(x))).otherwise(F.element_at(known, x))
    whole = lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, F.lit(kinds), F.lit(0))), x, lambda acc, y: F.replace(acc, y, several_of(y)))
    # Arrays of one element stand for a value that is used more than once.
    plain = lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.transform(F.array(F.translate(x, changed, to)), whole)[0])
    return F.transform(F.array(c), plain)[0]


def normalize_cedilla(c: Column) -> Column:
    return F.translate(c, "şţŞŢ", "șțȘȚ")


def collapse_ws(c: Column) -> Column:
    """Runs of blanks to one, lines stripped, empty lines dropped."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\f\\x0B\\u00A0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(plain: Column) -> Column:
    """Tokens without stop words, of a text that is lower-cased and without diacritics already."""
    return F.filter(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOPWORDS))


def tokenize(c: Column, stems: bool = False) -> Column:
    found = tokens(strip_diacritics(F.lower(c)))
    return stemmed(found) if stems else found


@pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Each token's stem; tasks stem a word once, as long as it is among the words seen of late."""
    return words.map(lambda a: None if a is None else [stem(w) for w in a])


@pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_vocabulary(df: DataFrame, tokens_column: str) -> DataFrame:
    """(term, stem) of the distinct tokens: each word is stemmed once, however often it occurs."""
    return df.select(F.explode(tokens_column).alias("term")).distinct().withColumn("stem", _stems("term"))

