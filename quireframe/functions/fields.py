"""Texts of a slide's fields: its number, and dates and times by kind and language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the kinds datetime, datetime1 and so on, in English, in Chinese and Japanese, and in Korean order (# a
# weekday, @ a half of the day).
ENGLISH = {
    "": "MM/dd/yyyy HH:mm", "1": "MM/dd/yyyy", "2": "EEEE, MMMM dd, yyyy", "3": "dd MMMM yyyy", "4": "MMMM dd, yyyy", "5": "dd-MMM-yy", "6": "MMMM yy", "7": "MMM-yy",
    "8": "MM/dd/yyyy hh:mm a", "9": "MM/dd/yyyy hh:mm:ss a", "10": "HH:mm", "11": "HH:mm:ss", "12": "hh:mm a", "13": "hh:mm:ss a",
}
CHINESE = {
    "": "yyyy/MM/dd HH:mm", "1": "yyyy/MM/dd", "2": "yyyy年M月dd日#", "3": "yyyy年M月dd日", "4": "yyyy年M月dd日", "5": "dd日-M月-yy年", "6": "yyyy年M月", "7": "yy年M月",
    "8": "yyyy/MM/dd @hh:mm", "9": "yyyy/MM/dd @hh:mm:ss", "10": "HH:mm", "11": "HH:mm:ss", "12": "@hh:mm", "13": "@hh:mm:ss",
}
KOREAN = {
    "": "yyyy. MM. dd. HH:mm", "1": "yyyy. MM. dd.", "2": "yyyy년 M월 dd일 #", "3": "yyyy년 M월 dd일", "4": "yyyy년 M월 dd일", "5": "dd일-M월-yy년", "6": "yyyy년 M월", "7": "yy년 M월",
    "8": "yyyy. MM. dd. @ hh:mm", "9": "yyyy. MM. dd. @ hh:mm:ss", "10": "HH:mm", "11": "HH:mm:ss", "12": "@ hh:mm", "13": "@ hh:mm:ss",
}
#: By language: patterns, weekdays from Sunday, halves of the day.
EAST_ASIAN = {
    "zh": (CHINESE, ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六"), ("上午", "下午")),
    "ja": (CHINESE, ("日曜日", "月曜日", "火曜日", "水曜日", "木曜日", "金曜日", "土曜日"), ("午前", "午後")),
    "ko": (KOREAN, ("일요일", "월요일", "화요일", "수요일", "목요일", "금요일", "토요일"), ("오전", "오후")),
}


def slide_field(kind: Column, fallback: Column, slide: Column, at: Column, language: Column) -> Column:
    """What a field shows: the slide's number for slidenum, the time ``at`` for datetime and datetime1 to datetime13.

    Chinese, Japanese and Korean fields have the order and names of their language, those of any other the English
    ones. Other kinds, a null kind, and a number or time that is null show the fallback.
    """
    kind = F.lower(kind)
    shown = F.when(kind == "slidenum", slide.cast("string"))
    for n in ENGLISH:
        own = F.date_format(at, ENGLISH[n])
        for code, (patterns, weekdays, halves) in EAST_ASIAN.items():
            half = F.when(F.hour(at) < 12, halves[0]).otherwise(halves[1])
            weekday = F.element_at(F.array(*map(F.lit, weekdays)), F.dayofweek(at))
            # Letters that are no pattern stand beside the parts that date_format() makes.
            there = F.replace(F.replace(F.date_format(at, patterns[n].replace("#", "'#'").replace("@", "'@'")), F.lit("#"), weekday), F.lit("@"), half)
            own = F.when(F.coalesce(F.lower(language).rlike(f"^{code}(?:-|$)"), F.lit(False)), there).otherwise(own)
        shown = shown.when(kind == f"datetime{n}", own)
    return F.coalesce(shown, fallback)
