"""Constant relations: the catalog and the page text that can be read as tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The catalog, in its own order.
CATALOG = (
    "amber-crt.html",
    "Amstrad_CPC_STYLE.html",
    "Apple_II_Style_UI.html",
    "Apple_Lisa.html",
    "Atari_800.html",
    "Commodore_64_Style_UI.html",
    "Green_Phosphor.html",
    "IBM_BLUE_PHOSPHOR.html",
    "nc1.html",
    "slovo_delo.html",
    "White_Gray_Phosphor.html",
    "Windows_1.0.html",
    "Windows_3.1_STYLE_UI.html",
    "Windows_95.html",
    "Xerox_Alto.html",
    "ZX_Spectrum_Style_UI.html",
)

# Directory rows (panel, path, name, ext, size) shown by two themes, one of which shows no path.
LISTING = (
    ("left", "C:\\WORK\\", "..", "<DIR>", None),
    ("left", "C:\\WORK\\", "DOC", None, 12456),
    ("left", "C:\\WORK\\", "README", None, 1024),
    ("right", "C:\\TEMP\\", "..", "<DIR>", None),
    ("right", "C:\\TEMP\\", "TXT", None, 45),
)
LISTING_DATE = "24-05-24"

# Menu labels, and where a theme's labels differ.
LONG_MENU = (
    "Предоставить анализ проблемы (ядро исследования) - бесплатно",
    "Сформировать план курсовой работы - бесплатно",
    "Создать введение к курсовой работе (на основе плана)",
    "СОЗДАТЬ КУРСОВУЮ РАБОТУ",
    "Подобрать источники к курсовой работе",
    "Отформатировать курсовую работу по ГОСТ",
    "Проверить текст на ИИ (ИИ-детектор)",
    "Очеловечить работу (убрать ИИ-паттерны)",
)
SHORT_MENUS = {
    "slovo_delo.html": ("Анализ темы", "План", "Введение", "Курсовая", "Источники", "ГОСТ", "ИИ анализ", "Очеловечивание"),
    "Green_Phosphor.html": ("Анализ темы", "План работы", "Введение", "Курсовая работа", "Источники", "ГОСТ формат", "AI анализ", "Очеловечивание"),
}
MISSPELT = ("Windows_1.0.html", 8, "Очеловечить работа (убрать ИИ-паттерны)")
NO_SELECTION = "amber-crt.html"

# Captions of the function keys, in order.
FUNCTION_KEYS = ("Help", "User", "View", "Edit", "Copy", "RenMov", "MkDir", "Delete", "PullDn", "Quit")


def theme_catalog(spark: SparkSession) -> DataFrame:
    """16 rows (ord, theme); ord counts from 0."""
    return spark.createDataFrame(list(enumerate(CATALOG)), "ord int not null, theme string not null")


def directory_listing(spark: SparkSession) -> DataFrame:
    """10 rows; empty cells are null, and the theme without a path has null there."""
    day = datetime.datetime.strptime(LISTING_DATE, "%y-%m-%d").date()
    rows = [
        (theme, panel, path if theme == "amber-crt.html" else None, name, ext, size, day)
        for theme in ("amber-crt.html", "nc1.html")
        for panel, path, name, ext, size in LISTING
    ]
    return spark.createDataFrame(rows, "theme string, panel string, path string, name string, ext string, size int, date date")


def menu_items(spark: SparkSession) -> DataFrame:
    """128 rows (theme, ord, label, selected); ord counts from 1, labels without their ordinal."""
    rows = []
    for theme in CATALOG:
        for k, label in enumerate(SHORT_MENUS.get(theme, LONG_MENU), 1):
            label = MISSPELT[2] if (theme, k) == MISSPELT[:2] else label
            rows.append((theme, k, label, k == 1 and theme != NO_SELECTION))
    return spark.createDataFrame(rows, "theme string, ord int, label string, selected boolean")


def striped_menu(spark: SparkSession) -> DataFrame:
    """Rows that the odd-child rule colours: the title is the first child, so the even items match."""
    return menu_items(spark).filter((F.col("ord") % 2 == 0) & (F.col("theme") == "ZX_Spectrum_Style_UI.html"))


def function_keys(spark: SparkSession) -> DataFrame:
    """10 rows (key, label) of the key bar shared by the two directory-panel themes."""
    return spark.createDataFrame(list(enumerate(FUNCTION_KEYS, 1)), "key int, label string")
