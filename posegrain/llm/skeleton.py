"""One consistent form for texts that look the same.

The skeleton of a text: decompose canonically, replace every character by its prototype in a look-alike table,
decompose again.  Two texts look the same if and only if their skeletons are equal, so grouping by the skeleton
replaces any comparison of pairs.  Differences a reader can see (case, accents, raised or circled digits, the
number of blanks, other letters) stay.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Letters of the same shape, prototype last.
SAME_SHAPE = (
    # Cyrillic small letters
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv үy "
    # Cyrillic capital letters
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ԌG ӀI ѴV "
    # Greek small letters
    "οo νv ρp ϲc ϳj "
    # Greek capital letters
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    # Cyrillic letters of the shape of Greek ones
    "ГΓ ПΠ ФΦ"
)
# Format characters that are visible, a blank that is visible, invisible characters of other categories.
VISIBLE_FORMAT = (0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
VISIBLE_BLANK = (0x1680,)
INVISIBLE_OTHER = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


@cache
def prototypes() -> dict[int, str]:
    """Code point -> prototype ('' for invisible characters), by rule: wide forms by their decomposition, blanks and
    format characters by category, variation selectors by range, letters by the fixed table."""
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs" and cp not in VISIBLE_BLANK:
            table[cp] = " "
        elif kind == "Cf" and cp not in VISIBLE_FORMAT:
            table[cp] = ""
        elif unicodedata.decomposition(ch).startswith("<wide>"):
            table[cp] = unicodedata.normalize("NFKC", ch)
    for cp in (*INVISIBLE_OTHER, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)):
        table[cp] = ""
    for pair in SAME_SHAPE.split():
        table[ord(pair[0])] = pair[1]
    del table[32]
    return table


def sql_look(text: str) -> str:
    """The same form as an SQL expression: composed instead of decomposed letters, every character by its prototype.

    Made from the table alone, for engines that can compose (nfc_normalize) and translate.  Characters whose prototype has
    several characters stay.
    """
    one, gone = {}, []
    for cp in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= cp < 0xE000:
            look = unicodedata.normalize("NFC", skeleton(chr(cp)))
            if not look:
                gone.append(chr(cp))
            elif len(look) == 1 and look != chr(cp):
                one[chr(cp)] = look
    quoted = lambda x: "'" + "".join(x).replace("'", "''") + "'"
    return f"nfc_normalize(translate(nfc_normalize({text}), {quoted([*one, *gone])}, {quoted(one.values())}))"


def skeleton(text: str) -> str:
    """The consistent form of one text.  ASCII texts are their own skeleton."""
    if text.isascii():
        return text
    replaced = unicodedata.normalize("NFD", text).translate(prototypes())
    return unicodedata.normalize("NFD", replaced)


#: ASCII texts have as many bytes as characters; they are their own skeleton and stay in the JVM.
_ASCII = "octet_length({0}) = char_length({0})"


def with_skeleton(docs: DataFrame, text: str = "text", out: str = "skeleton") -> DataFrame:
    """All columns of ``docs`` and the skeleton of ``text`` (null for null, empty for empty)."""

    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if t is None else skeleton(t) for t in s.to_pylist()], pa.string())

    plain = F.expr(_ASCII.format(f"`{text}`"))
    return docs.withColumn(out, F.when(plain, F.col(text)).otherwise(run(F.when(~plain, F.col(text)))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, look, stored): 128-bit digests of the skeleton and of the text as stored.  Null texts are left out.

    Only the digests are shuffled later, never the texts.
    """
    d = with_skeleton(docs.select(F.col(id_col), F.col(text).cast("string").alias("_t")).where("_t is not null"), "_t", "_s")
    digest = lambda c: F.unhex(F.substring(F.sha2(F.col(c), 256), 1, 32))
    d = d.select(id_col, "_t", "_s", digest("_t").alias("stored"))
    return d.select(id_col, F.when(F.expr(_ASCII.format("_t")), F.col("stored")).otherwise(digest("_s")).alias("look"), "stored")


def classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: class_id (the smallest id of the texts that look the same), n_documents and n_spellings of the
    class, n_links (documents of the class that are stored otherwise).

    Copies are counted before anything is shuffled (one row a stored text and task), classes are made of stored texts, and
    documents only look up their text's row, so a class of any size costs no more than its rows.
    """
    texts = prints.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first"))
    whole = texts.groupBy("look").agg(F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_spellings"), F.min("first").alias("class_id"))
    texts = texts.select("look", "stored", "n").join(whole, "look").select("look", "stored", "class_id", "n_documents", "n_spellings", (F.col("n_documents") - F.col("n")).alias("n_links"))
    return prints.join(texts, ["look", "stored"]).select(id_col, "class_id", "n_documents", "n_spellings", "n_links")


def same_look_pairs(prints: DataFrame, id_col: str = "doc_id", salts: int = 8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: documents that differ as stored and look the same.  ``classes`` is the form without pairs.

    Copies are counted first (one row a stored text and task), then only classes with two or more stored texts
    go on.  Pairs are made between stored texts, and documents join them by text, so documents of the same stored
    text are never compared with each other; the output holds exactly the pairs asked for.  A text that very many
    documents share is spread: one side of a pair over ``salts`` tasks, the other side goes to each of them.
    """
    variants = prints.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    mixed = variants.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("look")
    docs = prints.join(mixed, "look", "left_semi")
    texts = docs.select("look", "stored").distinct()
    links = texts.withColumnRenamed("stored", "stored_a").join(texts.withColumnRenamed("stored", "stored_b"), "look").where("stored_a < stored_b")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    links = links.select("*", every.alias("_salt"))
    a = docs.select(F.col("look"), F.col("stored").alias("stored_a"), F.col(id_col).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("_salt"))
    b = docs.select(F.col("look"), F.col("stored").alias("stored_b"), F.col(id_col).alias("y"), every.alias("_salt"))
    pairs = links.join(a, ["look", "stored_a", "_salt"]).join(b, ["look", "stored_b", "_salt"])
    return pairs.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).where(f"{id_col}_a < {id_col}_b")
