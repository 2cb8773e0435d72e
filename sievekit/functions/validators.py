"""Validators that need more than SQL, as Arrow-batched functions over the few matches that reach them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions import scalars

# Card numbers that issuers publish for tests.
TEST_CARDS = frozenset("4111111111111111 4242424242424242 4000000000000002 5555555555554444 5105105105105100 378282246310005 371449635398431 6011111111111117 30569309025904 3530111333300000 3566002020360505".split())
# The prefectures of an address.
PREFECTURES = "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県".split()
# Labels before a name, and words that show that no name follows.
NAME_LABELS = ("お名前", "氏名", "名前", "Name", "name")
NO_NAMES_ASCII = ("test", "sample", "dummy", "mock", "version", "class", "function")
NO_NAMES = ("入力", "必須", "サンプル", "テスト", "ダミー", "モック")

_NARROW = str.maketrans(scalars.WIDE, scalars.NARROW)
_DIGITS = str.maketrans(scalars.WIDE[:10], scalars.NARROW[:10])
_CITY = re.compile("(" + "|".join(PREFECTURES) + ")")
_BLOCK = re.compile(r"[0-9](?=[丁番号条])|[0-9]-[0-9]")
_JP_NAME = re.compile("[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]")


def _sum_is_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def luhn(text: str) -> bool:
    """Whether some card-like run of 13 to 19 digits passes Luhn's check and is no published test card.

    A run may have single separators; then its first group has four digits at least.  A run that goes on another group of
    four or more digits behind it is not looked at by itself, unless both together are too long.
    """
    text = text.translate(_DIGITS)
    for m in re.finditer(r"(?<![0-9])[0-9]", text):
        at = m.start()
        run = re.compile(r"[0-9]+(?:[ \t\-　][0-9]+)*[ \t\-　]?").match(text, at)[0]
        before = re.search(r"([0-9]+)[ \t\-　]+$", text[:at])
        digits = re.sub("[^0-9]", "", run)
        if before and len(before[1]) >= 4 and len(before[1]) + len(digits) <= 19:
            continue
        if not 13 <= len(digits) <= 19 or not run[-1].isdigit() or digits in TEST_CARDS:
            continue
        groups = re.split(r"[ \t\-　]", run)
        if len(groups) > 1 and len(groups[0]) < 4:
            continue
        if _sum_is_valid(digits):
            return True
    return False


def address(text: str) -> bool:
    """A prefecture, within 40 characters a municipality, within 40 more a block number."""
    text = text.translate(_NARROW)
    m = _CITY.search(text)
    if not m:
        return False
    city = re.search("[市区町村]", text[m.end() : m.end() + 40])
    return bool(city) and bool(_BLOCK.search(text[m.end() + city.end() : m.end() + city.end() + 40]))


def person_name(text: str) -> bool:
    """A label, then a value that looks like a name: Japanese letters alone, or two to four words of Latin letters."""
    text = text.translate(_NARROW)
    label = next((x for x in NAME_LABELS if x in text), None)
    if label is None:
        return False
    value = text[text.index(label) + len(label) :].lstrip()
    if value.startswith("を"):
        return False
    value = value.lstrip(":：=は- \t　\"'").strip().strip("\"' \t　").strip()
    solid = re.sub(r"\s", "", value)
    if not 2 <= len(solid) <= 40 or any(w in value.lower() for w in NO_NAMES_ASCII) or any(w in value for w in NO_NAMES):
        return False
    if _JP_NAME.search(value):
        return all(_JP_NAME.match(c) for c in solid)
    words = value.split()
    return 2 <= len(words) <= 4 and all(len(w) >= 2 and w.isascii() and w.isalpha() for w in words)


def mynumber(text: str) -> bool:
    """Whether some run of digits, with separators inside, has exactly twelve."""
    joined = re.sub("(?<=[0-9])[ \t　\\-－―‐‑–—ー]+(?=[0-9])", "", text.translate(_DIGITS))
    return any(len(run) == 12 for run in re.findall("[0-9]+", joined))


def mobile(text: str) -> bool:
    return bool(re.fullmatch("0[789]0[0-9]{8}", re.sub("[^0-9]", "", text.translate(_DIGITS))))


def _vectorised(check):
    @F.pandas_udf("boolean")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: bool(t) and check(t)).astype(bool)

    return run


def valid(name: str | None, text: Column) -> Column:
    """Whether a match passes the named validator; without a name, all do."""
    if name is None:
        return F.lit(True)
    if name == "jp_mynumber_len12":
        return scalars.mynumber_length(text)
    if name == "jp_phone_mobile":
        return scalars.mobile_number(text)
    return _vectorised({"luhn": luhn, "jp_address_prefecture_city_block": address, "jp_person_name_keyword": person_name}[name])(text)
