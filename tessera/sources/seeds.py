"""Dimension tables that come with the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_csv_strict

#: Verses of the chapters, in order: fixed values.
VERSES = (
    7, 286, 200, 176, 120, 165, 206, 75, 129, 109, 123, 111, 43, 52, 99, 128, 111, 110, 98, 135, 112, 78, 118, 64, 77, 227, 93, 88, 69, 60, 34, 30, 73, 54, 45, 83, 182, 88, 75, 85,
    54, 53, 89, 59, 37, 35, 38, 29, 18, 45, 60, 49, 62, 55, 78, 96, 29, 22, 24, 13, 14, 11, 11, 18, 12, 12, 30, 52, 52, 44, 28, 28, 20, 56, 40, 31, 50, 40, 46, 42,
    29, 19, 36, 25, 22, 17, 19, 26, 30, 20, 15, 21, 11, 8, 8, 19, 5, 8, 8, 11, 11, 8, 3, 9, 5, 4, 7, 3, 6, 3, 5, 4, 5, 6,
)
#: Codes and names of the collections, in order: fixed values.
COLLECTIONS = (("SB", "صحيح البخاري"), ("SM", "صحيح مسلم"), ("SD", "سنن أبي داود"), ("JT", "جامع الترمذي"), ("SN", "سنن النسائى الصغرى"), ("IM", "سنن ابن ماجه"))
#: Chapters revealed in Medina; all others in Mecca: fixed values.
MEDINAN = (2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110)
#: Reciters' names, Arabic names, styles and the folders of their recordings, in order: fixed values.
RECITERS = (
    ("Mishary Alafasy", "مشاري العفاسي", "Murattal", "Alafasy_128kbps"),
    ("Abdul Basit (Murattal)", "عبد الباسط عبد الصمد", "Murattal", "Abdul_Basit_Murattal_192kbps"),
    ("Abdul Basit (Mujawwad)", None, "Mujawwad", "Abdul_Basit_Mujawwad_128kbps"),
    ("Al-Husary", "محمود خليل الحصري", "Murattal", "Husary_128kbps"),
    ("Al-Husary (Muallim)", None, "Teaching", "Husary_Muallim_128kbps"),
    ("As-Sudais", "عبدالرحمن السديس", "Murattal", "Abdurrahmaan_As-Sudais_192kbps"),
    ("Al-Ghamdi", "سعد الغامدي", "Murattal", "Ghamadi_40kbps"),
    ("Maher Al-Muaiqly", "ماهر المعيقلي", "Murattal", "MaherAlMuaiqly128kbps"),
    ("Muhammad Ayyoub", "محمد أيوب", "Murattal", "Muhammad_Ayyoub_128kbps"),
    ("Hani Ar-Rifai", "هاني الرفاعي", "Murattal", "Hani_Rifai_192kbps"),
    ("Abu Bakr Ash-Shatri", "أبو بكر الشاطري", "Murattal", "Abu_Bakr_Ash-Shaatree_128kbps"),
    ("Nasser Al-Qatami", "ناصر القطامي", "Murattal", "Nasser_Alqatami_128kbps"),
    ("Warsh (Abdul Basit)", None, "Warsh", "warsh/warsh_Abdul_Basit_128kbps"),
)


def read_chapter_names(spark: SparkSession, path: str) -> DataFrame:
    """chapter, name_ar, name_en and name_latin from a CSV file with these columns; 456 names are data, not code.

    Every chapter must be there once, with all three names.
    """
    rows = read_csv_strict(spark, path, "chapter int, name_ar string, name_en string, name_latin string")
    named = rows.where("name_ar <> '' and name_en <> '' and name_latin <> ''").select("chapter")
    if named.where(F.col("chapter").between(1, len(VERSES))).distinct().count() != len(VERSES) or rows.count() != len(VERSES):
        raise ValueError(f"{path} must name each of the {len(VERSES)} chapters once")
    return rows


def chapters(spark: SparkSession, names: DataFrame | None = None) -> DataFrame:
    """chapter, verses, first (the number of the chapter's first verse in the whole book, from 1) and revelation; with names, also these."""
    rows, before = [], 0
    for i, n in enumerate(VERSES, 1):
        rows.append((i, n, before + 1, "Medinan" if i in MEDINAN else "Meccan"))
        before += n
    made = spark.createDataFrame(rows, "chapter int, verses int, first int, revelation string")
    return made if names is None else made.join(names, "chapter", "left")


def collections(spark: SparkSession) -> DataFrame:
    """collection (from 1), code and name."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(COLLECTIONS, 1)], "collection int, code string, name string")


def reciters(spark: SparkSession) -> DataFrame:
    """reciter (from 1), name, Arabic name and style, folder, and the bit rate that the folder's name ends with."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(RECITERS, 1)], "reciter int, name string, name_ar string, style string, folder string")
    return rows.withColumn("kbps", F.regexp_extract("folder", r"(\d+)kbps$", 1).cast("int"))
