"""Words, sections and positions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections of a document by weight; a position word holds the section in bits 14-15 and the position below.
BODY, DESCRIPTION, KEYWORDS, TITLE = 0, 1, 2, 3
POSITION_MASK, SECTION_SHIFT = 0x3FFF, 14
MAX_WORD = 32
WORD = r"([\p{L}0-9]+)"

#: Common words by language. They aren't indexed, but positions go on over them.
STOPWORDS = {
    "en": "a about after all also an and any are as at be been but by can for from had has have he her his how i if in into is it its more no not of on one or "
          "our out she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer eines er es für hat ich im in ist mit nach nicht oder sich sie "
          "sind so um und von vor war wie wird zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous",
    "es": "al como con de del el en es esta este la las lo los más no o para pero por que se sin sobre su sus un una y",
}


def words(text: Column | str) -> Column:
    """Lowercased words; a null text has a null list."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def stopwords(*languages: str) -> list[str]:
    return sorted({w for lang in languages or STOPWORDS for w in STOPWORDS[lang].split()})


def position_word(section: Column, position: Column) -> Column:
    """Section and position in 16 bits; positions wrap at 14."""
    return (F.shiftleft(section, SECTION_SHIFT) + position.bitwiseAND(F.lit(POSITION_MASK))).cast("int")


def tokens(documents: DataFrame, keys: list[str], sections: dict[int, str]) -> DataFrame:
    """keys, section, word, pos (from 0 in each section) for every word of the given text columns."""
    texts = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("text")) for s, c in sections.items()])).alias("t")
    each = documents.select(*keys, texts).where(F.length("t.text") > 0)
    return each.select(*keys, F.col("t.section").alias("section"), F.posexplode(words("t.text")).alias("pos", "word"))


def indexable(rows: DataFrame, stop: list[str] = (), shortest: int = 1, longest: int = MAX_WORD) -> DataFrame:
    """Rows whose word is neither too short nor too long nor a stopword; the others keep their positions free."""
    size = F.length("word")
    rows = rows.where((size >= shortest) & (size <= longest))
    return rows.where(~F.col("word").isin(list(stop))) if stop else rows


def languages(rows: DataFrame, key: str) -> DataFrame:
    """key, lang, hits: the language whose stopwords a document has most of (ties: the first by name)."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(lang, w) for lang, ws in sorted(STOPWORDS.items()) for w in ws.split()], "lang string, word string")
    hits = rows.join(F.broadcast(known), "word").groupBy(key, "lang").agg(F.count(F.lit(1)).alias("hits"))
    best = F.min(F.struct((-F.col("hits")).alias("h"), "lang")).alias("b")
    return hits.groupBy(key).agg(best).select(key, F.col("b.lang").alias("lang"), (-F.col("b.h")).alias("hits"))


def ngrams(text: Column | str, n: int) -> Column:
    """All n-grams inside words, overlapping, in one native call: matches of a lookahead have no length."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?=([\p{{L}}0-9]{{{n}}}))"), 1)


def letter_ngrams(documents: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """gram, n_docs, total of the letter n-grams inside words: the profile that a charset or language guess compares."""
    grams = documents.select(key, F.explode(ngrams(text, n)).alias("gram"))
    per_doc = grams.groupBy("gram", key).agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("c").alias("total"))
