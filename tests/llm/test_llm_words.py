import re

from lexframe.llm.common import alnum_words, blank_words, held_out
from pyspark.sql import functions as F
import zlib

TEXTS = ["", " ", "A-b_c 12 É\x1cx\x85y z", "a\x0bb\x0cc\x00d", "ß İ ﬁ　wide 日本"]


def test_words_follow_their_patterns():
    for text in TEXTS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert [w.decode() for w in alnum_words(text.encode())] == re.findall(
            r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert [w.decode() for w in blank_words(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", low)


def test_split_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(-5, 200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
