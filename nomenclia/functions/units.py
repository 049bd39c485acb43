"""Units of measure: dimensions and factors, names in the catalogue, spellings in free text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.functions.text import literal_map

# ---------------------------------------------------------------- fixed values
# key | symbol | dimension | factor to the dimension's base unit
UNIT_TABLE = (
    ("nm", "нм", "length", 1e-6),
    ("um", "мкм", "length", 1e-3),
    ("mm", "мм", "length", 1.0),
    ("cm", "см", "length", 10.0),
    ("dm", "дм", "length", 100.0),
    ("m", "м", "length", 1000.0),
    ("km", "км", "length", 1e6),
    ("inch", "дюйм", "length", 25.4),
    ("mg", "мг", "mass", 1e-3),
    ("g", "г", "mass", 1.0),
    ("kg", "кг", "mass", 1000.0),
    ("t", "т", "mass", 1e6),
    ("mm3", "мм³", "volume", 1e-3),
    ("ml", "мл", "volume", 1.0),
    ("l", "л", "volume", 1000.0),
    ("m3", "м³", "volume", 1e6),
    ("mm2", "мм²", "area", 1.0),
    ("cm2", "см²", "area", 100.0),
    ("m2", "м²", "area", 1e6),
    ("km2", "км²", "area", 1e12),
    ("ha", "га", "area", 1e10),
    ("gm2", "г/м²", "areal_density", 1.0),
    ("kgm3", "кг/м³", "density", 1.0),
    ("w", "Вт", "power", 1.0),
    ("kw", "кВт", "power", 1e3),
    ("mw", "МВт", "power", 1e6),
    ("hp", "л.с.", "power", 735.49875),
    ("va", "В·А", "apparent_power", 1.0),
    ("kva", "кВ·А", "apparent_power", 1e3),
    ("v", "В", "voltage", 1.0),
    ("kv", "кВ", "voltage", 1e3),
    ("ma", "мА", "current", 1e-3),
    ("a", "А", "current", 1.0),
    ("mah", "мА·ч", "charge", 1e-3),
    ("ah", "А·ч", "charge", 1.0),
    ("ohm", "Ом", "resistance", 1.0),
    ("hz", "Гц", "frequency", 1.0),
    ("khz", "кГц", "frequency", 1e3),
    ("mhz", "МГц", "frequency", 1e6),
    ("ghz", "ГГц", "frequency", 1e9),
    ("rpm", "об/мин", "rotation", 1.0),
    ("rps", "об/с", "rotation", 60.0),
    ("us", "мкс", "time", 1e-6),
    ("ms", "мс", "time", 1e-3),
    ("s", "с", "time", 1.0),
    ("min", "мин", "time", 60.0),
    ("h", "ч", "time", 3600.0),
    ("day", "сут", "time", 86400.0),
    ("month", "мес", "calendar", 1.0),
    ("year", "год", "calendar", 12.0),
    ("degc", "°C", "temperature", 1.0),
    ("kelvin", "K", "temperature_k", 1.0),
    ("deg", "°", "angle", 1.0),
    ("arcmin", "'", "angle", 1 / 60),
    ("arcsec", '"', "angle", 1 / 3600),
    ("pct", "%", "percent", 1.0),
    ("pcs", "шт", "count", 1.0),
    ("kpcs", "тыс. шт", "count", 1000.0),
    ("pair", "пар", "pair", 1.0),
    ("person", "чел", "person", 1.0),
    ("sheet", "лист", "sheet", 1.0),
    ("unit", "ед", "unit", 1.0),
    ("point", "балл", "point", 1.0),
    ("rub", "руб", "money", 1.0),
    ("bit", "бит", "data", 0.125),
    ("byte", "байт", "data", 1.0),
    ("kb", "КБ", "data", 1024.0),
    ("mb", "МБ", "data", 1024.0 ** 2),
    ("gb", "ГБ", "data", 1024.0 ** 3),
    ("tb", "ТБ", "data", 1024.0 ** 4),
    ("bps", "бит/с", "data_rate", 1.0),
    ("kbps", "Кбит/с", "data_rate", 1e3),
    ("mbps", "Мбит/с", "data_rate", 1e6),
    ("gbps", "Гбит/с", "data_rate", 1e9),
    ("mbyteps", "МБ/с", "data_rate", 8e6),
    ("gbyteps", "ГБ/с", "data_rate", 8e9),
    ("pa", "Па", "pressure", 1.0),
    ("kpa", "кПа", "pressure", 1e3),
    ("mpa", "МПа", "pressure", 1e6),
    ("bar", "бар", "pressure", 1e5),
    ("mbar", "мбар", "pressure", 100.0),
    ("atm", "атм", "pressure", 101325.0),
    ("mmhg", "мм рт. ст.", "pressure", 133.322),
    ("cmh2o", "см вод. ст.", "pressure", 98.0665),
    ("j", "Дж", "energy", 1.0),
    ("kj", "кДж", "energy", 1e3),
    ("wh", "Вт·ч", "energy", 3600.0),
    ("kwh", "кВт·ч", "energy", 3.6e6),
    ("db", "дБ", "sound", 1.0),
    ("lm", "лм", "luminous_flux", 1.0),
    ("lx", "лк", "illuminance", 1.0),
    ("n", "Н", "force", 1.0),
    ("tesla", "Тл", "magnetic", 1.0),
    ("mps", "м/с", "speed", 1.0),
    ("kmh", "км/ч", "speed", 1 / 3.6),
    ("mph", "м/ч", "speed", 1 / 3600),
    ("m3h", "м³/ч", "flow", 1.0),
    ("m3s", "м³/с", "flow", 3600.0),
    ("km3day", "тыс. м³/сут", "flow", 1000 / 24),
    ("km3h", "тыс. м³/ч", "flow", 1000.0),
    ("th", "т/ч", "mass_flow", 1.0),
    ("tday", "т/сут", "mass_flow", 1 / 24),
    ("kgs", "кг/с", "mass_flow", 3.6),
    ("ktyear", "тыс. т/год", "mass_flow", 1000 / 8760),
    ("mtyear", "млн т/год", "mass_flow", 1e6 / 8760),
    ("ci", "Ки", "radioactivity", 1.0),
)

# name in the catalogue's unit dictionary | key
OKEI_TABLE = (
    ("миллиметр", "mm"),
    ("сантиметр", "cm"),
    ("дециметр", "dm"),
    ("метр", "m"),
    ("погонный метр", "m"),
    ("километр; тысяча метров", "km"),
    ("нанометр", "nm"),
    ("микрометр", "um"),
    ("дюйм (25,4 мм)", "inch"),
    ("миллиграмм", "mg"),
    ("грамм", "g"),
    ("килограмм", "kg"),
    ("тонна; метрическая тонна (1000 кг)", "t"),
    ("кубический миллиметр", "mm3"),
    ("кубический сантиметр; миллилитр", "ml"),
    ("литр; кубический дециметр", "l"),
    ("кубический метр", "m3"),
    ("квадратный миллиметр", "mm2"),
    ("квадратный сантиметр", "cm2"),
    ("квадратный метр", "m2"),
    ("квадратный километр", "km2"),
    ("гектар", "ha"),
    ("килограмм на кубический метр", "kgm3"),
    ("ватт", "w"),
    ("киловатт", "kw"),
    ("мегаватт; тысяча киловатт", "mw"),
    ("лошадиная сила", "hp"),
    ("вольт-ампер", "va"),
    ("киловольт-ампер", "kva"),
    ("вольт", "v"),
    ("киловольт", "kv"),
    ("ампер", "a"),
    ("ампер-час (3,6 ккл)", "ah"),
    ("ом", "ohm"),
    ("герц", "hz"),
    ("килогерц", "khz"),
    ("мегагерц", "mhz"),
    ("гигагерц", "ghz"),
    ("оборот в минуту", "rpm"),
    ("оборот в секунду", "rps"),
    ("микросекунда", "us"),
    ("миллисекунда", "ms"),
    ("секунда", "s"),
    ("минута", "min"),
    ("час", "h"),
    ("сутки", "day"),
    ("месяц", "month"),
    ("год", "year"),
    ("градус цельсия", "degc"),
    ("кельвин", "kelvin"),
    ("градус (плоского угла)", "deg"),
    ("минута (плоского угла)", "arcmin"),
    ("секунда (плоского угла)", "arcsec"),
    ("процент", "pct"),
    ("штука", "pcs"),
    ("тысяча штук", "kpcs"),
    ("пара (2 шт.)", "pair"),
    ("человек", "person"),
    ("лист", "sheet"),
    ("единица", "unit"),
    ("балл", "point"),
    ("рубль", "rub"),
    ("бит", "bit"),
    ("байт", "byte"),
    ("килобайт", "kb"),
    ("мегабайт", "mb"),
    ("гигабайт", "gb"),
    ("терабайт", "tb"),
    ("бит в секунду", "bps"),
    ("килобит в секунду", "kbps"),
    ("мегабит в секунду", "mbps"),
    ("гигабит в секунду", "gbps"),
    ("мегабайт в секунду", "mbyteps"),
    ("гигабайт в секунду", "gbyteps"),
    ("паскаль", "pa"),
    ("килопаскаль", "kpa"),
    ("мегапаскаль", "mpa"),
    ("бар", "bar"),
    ("миллибар", "mbar"),
    ("физическая атмосфера (101325 па)", "atm"),
    ("миллиметр ртутного столба", "mmhg"),
    ("сантиметр водяного столба", "cmh2o"),
    ("джоуль", "j"),
    ("килоджоуль", "kj"),
    ("ватт-час", "wh"),
    ("киловатт-час", "kwh"),
    ("децибел", "db"),
    ("люмен", "lm"),
    ("люкс", "lx"),
    ("ньютон", "n"),
    ("тесла", "tesla"),
    ("метр в секунду", "mps"),
    ("километр в час", "kmh"),
    ("метр в час", "mph"),
    ("кубический метр в час", "m3h"),
    ("кубический метр в секунду", "m3s"),
    ("тысяча кубических метров в сутки", "km3day"),
    ("тонна в час", "th"),
    ("тонна в сутки", "tday"),
    ("килограмм в секунду", "kgs"),
    ("тысяча метров кубических в час", "km3h"),
    ("тысяча тонн в год", "ktyear"),
    ("миллион тонн в год", "mtyear"),
    ("кюри", "ci"),
)

# spelling in free text | key | weak, for single letters that are also words
ALIAS_TABLE = (
    (r"мм\s?рт\.?\s?ст\.?", "mmhg", False),
    (r"см\s?вод\.?\s?ст\.?", "cmh2o", False),
    (r"миллиметр(?:ов|а|ы)?", "mm", False),
    (r"мм", "mm", False),
    (r"mm", "mm", False),
    (r"сантиметр(?:ов|а|ы)?", "cm", False),
    (r"см", "cm", False),
    (r"cm", "cm", False),
    (r"дециметр(?:ов|а|ы)?", "dm", False),
    (r"дм", "dm", False),
    (r"километр(?:ов|а|ы)?", "km", False),
    (r"км", "km", False),
    (r"микрон(?:ов|а|ы)?", "um", False),
    (r"мкм", "um", False),
    (r"нанометр(?:ов|а|ы)?", "nm", False),
    (r"нм", "nm", False),
    (r"погонн(?:ый|ых|ого)\s+метр(?:ов|а)?", "m", False),
    (r"пог\.?\s?м", "m", False),
    (r"метр(?:ов|а|ы)?", "m", False),
    (r"м", "m", True),
    (r"дюйм(?:ов|а|ы)?", "inch", False),
    (r'"', "inch", False),
    (r"''", "inch", False),
    (r"миллиграмм(?:ов|а|ы)?", "mg", False),
    (r"мг", "mg", False),
    (r"килограмм(?:ов|а|ы)?", "kg", False),
    (r"кг", "kg", False),
    (r"kg", "kg", False),
    (r"грамм(?:ов|а|ы)?", "g", False),
    (r"гр\.?", "g", False),
    (r"г", "g", True),
    (r"тонн(?:а|ы)?", "t", False),
    (r"т", "t", True),
    (r"миллилитр(?:ов|а|ы)?", "ml", False),
    (r"мл", "ml", False),
    (r"ml", "ml", False),
    (r"литр(?:ов|а|ы)?", "l", False),
    (r"л", "l", True),
    (r"куб\.?\s?см", "ml", False),
    (r"см3", "ml", False),
    (r"см³", "ml", False),
    (r"куб\.?\s?м(?:етр(?:ов|а)?)?", "m3", False),
    (r"м3", "m3", False),
    (r"м³", "m3", False),
    (r"дм3", "l", False),
    (r"кв\.?\s?мм", "mm2", False),
    (r"мм2", "mm2", False),
    (r"мм²", "mm2", False),
    (r"кв\.?\s?см", "cm2", False),
    (r"см2", "cm2", False),
    (r"см²", "cm2", False),
    (r"кв\.?\s?м(?:етр(?:ов|а)?)?", "m2", False),
    (r"м2", "m2", False),
    (r"м²", "m2", False),
    (r"га", "ha", False),
    (r"г\s?/\s?м2", "gm2", False),
    (r"г\s?/\s?м²", "gm2", False),
    (r"г\s?/\s?кв\.?\s?м", "gm2", False),
    (r"гр\s?/\s?м2", "gm2", False),
    (r"кг\s?/\s?м3", "kgm3", False),
    (r"кг\s?/\s?м³", "kgm3", False),
    (r"киловатт(?:ов|а|ы)?", "kw", False),
    (r"квт", "kw", False),
    (r"kw", "kw", False),
    (r"мегаватт(?:ов|а|ы)?", "mw", False),
    (r"мвт", "mw", False),
    (r"ватт(?:ов|а|ы)?", "w", False),
    (r"вт", "w", False),
    (r"w", "w", False),
    (r"л\.\s?с\.?", "hp", False),
    (r"лошадин(?:ая|ых)\s+сил[аы]?", "hp", False),
    (r"кв\s?[·*.]?\s?а", "kva", False),
    (r"в\s?[·*]\s?а", "va", False),
    (r"ва", "va", False),
    (r"киловольт(?:ов|а)?", "kv", False),
    (r"кв", "kv", False),
    (r"вольт(?:ов|а|ы)?", "v", False),
    (r"в", "v", True),
    (r"v", "v", False),
    (r"ма\s?[·*/]?\s?ч", "mah", False),
    (r"mah", "mah", False),
    (r"ампер[-\s]?час(?:ов|а)?", "ah", False),
    (r"а\s?[·*/]?\s?ч", "ah", False),
    (r"ah", "ah", False),
    (r"миллиампер(?:ов|а)?", "ma", False),
    (r"ма", "ma", False),
    (r"ампер(?:ов|а|ы)?", "a", False),
    (r"а", "a", True),
    (r"ом", "ohm", False),
    (r"гигагерц(?:ов|а)?", "ghz", False),
    (r"ггц", "ghz", False),
    (r"мегагерц(?:ов|а)?", "mhz", False),
    (r"мгц", "mhz", False),
    (r"килогерц(?:ов|а)?", "khz", False),
    (r"кгц", "khz", False),
    (r"герц(?:ов|а)?", "hz", False),
    (r"гц", "hz", False),
    (r"об\.?\s?/\s?мин\.?", "rpm", False),
    (r"оборот(?:ов|а|ы)?\s+в\s+минуту", "rpm", False),
    (r"rpm", "rpm", False),
    (r"об\.?\s?/\s?с", "rps", False),
    (r"миллисекунд(?:а|ы)?", "ms", False),
    (r"мс", "ms", False),
    (r"секунд(?:а|ы)?", "s", False),
    (r"сек\.?", "s", False),
    (r"с", "s", True),
    (r"минут(?:а|ы)?", "min", False),
    (r"мин\.?", "min", False),
    (r"час(?:ов|а)?", "h", False),
    (r"ч", "h", False),
    (r"сут(?:ок|ки)?", "day", False),
    (r"месяц(?:ев|а)?", "month", False),
    (r"мес\.?", "month", False),
    (r"год(?:а)?", "year", False),
    (r"лет", "year", False),
    (r"°\s?c", "degc", False),
    (r"°\s?с", "degc", False),
    (r"градус(?:ов|а)?\s+цельсия", "degc", False),
    (r"градус(?:ов|а)?", "deg", False),
    (r"°", "deg", False),
    (r"процент(?:ов|а)?", "pct", False),
    (r"%", "pct", False),
    (r"тыс\.?\s?шт\.?", "kpcs", False),
    (r"штук(?:и)?", "pcs", False),
    (r"шт\.?", "pcs", False),
    (r"pcs", "pcs", False),
    (r"пар(?:а|ы)?", "pair", False),
    (r"человек", "person", False),
    (r"чел\.?", "person", False),
    (r"лист(?:ов|а)?", "sheet", False),
    (r"терабайт(?:ов|а)?", "tb", False),
    (r"тб", "tb", False),
    (r"tb", "tb", False),
    (r"гигабайт(?:ов|а)?", "gb", False),
    (r"гб", "gb", False),
    (r"gb", "gb", False),
    (r"мегабайт(?:ов|а)?", "mb", False),
    (r"мб", "mb", False),
    (r"mb", "mb", False),
    (r"килобайт(?:ов|а)?", "kb", False),
    (r"кб", "kb", False),
    (r"гбит\s?/\s?с", "gbps", False),
    (r"мбит\s?/\s?с", "mbps", False),
    (r"кбит\s?/\s?с", "kbps", False),
    (r"мегапаскал(?:ь|я|ей)", "mpa", False),
    (r"мпа", "mpa", False),
    (r"килопаскал(?:ь|я|ей)", "kpa", False),
    (r"кпа", "kpa", False),
    (r"паскал(?:ь|я|ей)", "pa", False),
    (r"па", "pa", False),
    (r"мбар", "mbar", False),
    (r"бар(?:а|ов)?", "bar", False),
    (r"атм\.?", "atm", False),
    (r"квт\s?[·*]?\s?ч", "kwh", False),
    (r"вт\s?[·*]?\s?ч", "wh", False),
    (r"кдж", "kj", False),
    (r"дж", "j", False),
    (r"децибел(?:ов|а)?", "db", False),
    (r"дб", "db", False),
    (r"люмен(?:ов|а)?", "lm", False),
    (r"лм", "lm", False),
    (r"люкс(?:ов|а)?", "lx", False),
    (r"лк", "lx", False),
    (r"ньютон(?:ов|а)?", "n", False),
    (r"н", "n", True),
    (r"м\s?/\s?с", "mps", False),
    (r"км\s?/\s?ч", "kmh", False),
    (r"м3\s?/\s?ч", "m3h", False),
    (r"м³\s?/\s?ч", "m3h", False),
    (r"т\s?/\s?ч", "th", False),
)
# ----------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    key: str
    symbol: str
    dimension: str
    factor: float


UNITS = {k: Unit(k, symbol, dimension, float(factor)) for k, symbol, dimension, factor in UNIT_TABLE}
OKEI = dict(OKEI_TABLE)
ALIASES = list(ALIAS_TABLE)


def units_frame(spark: SparkSession) -> DataFrame:
    """The dimension table: unit, symbol, dimension, factor (a few kilobytes)."""
    return spark.createDataFrame([(u.key, u.symbol, u.dimension, u.factor) for u in UNITS.values()], "unit string, symbol string, dimension string, factor double")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(literal_map(pairs), key)


def unit_from_okei(name: Column) -> Column:
    """Key of the unit that a catalogue name stands for, else null."""
    tidy = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))
    return _lookup(OKEI, tidy)


def unit_symbol(name: Column) -> Column:
    """Symbol of the unit that a catalogue name stands for, else the name."""
    return F.coalesce(_lookup({n: UNITS[k].symbol for n, k in OKEI.items()}, F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("ё"), F.lit("е")), r"(?U)\s+", " "))), name, F.lit(""))


def dimension(unit: Column) -> Column:
    return _lookup({k: u.dimension for k, u in UNITS.items()}, unit)


def factor(unit: Column) -> Column:
    return _lookup({k: u.factor for k, u in UNITS.items()}, unit)


def symbol(unit: Column) -> Column:
    return _lookup({k: u.symbol for k, u in UNITS.items()}, unit)


def convert(value: Column, source: Column, target: Column) -> Column:
    """``value`` in another unit, null if the dimensions differ."""
    return F.when(dimension(source) == dimension(target), value * factor(source) / factor(target))


def spellings(pattern: str) -> set[str]:
    """What a spelling's pattern stands for, without spaces and dots: each choice of its groups and classes."""
    text = pattern.replace(r"\s", " ")
    inner = re.search(r"\(\?:([^()]*)\)(\??)|\[([^]]*)\](\??)", text)
    if inner is None:
        return {re.sub(r"\\.\??| [?+*]?", "", text)}
    choices = list(inner[3]) if inner[1] is None else inner[1].split("|")
    if inner[2] or inner[4]:
        choices.append("")
    return set().union(*(spellings(text[: inner.start()] + c + text[inner.end() :]) for c in choices))


#: Unit and weakness by spelling without spaces and dots.
SPELT = {s: (key, weak) for pattern, key, weak in reversed(ALIASES) for s in spellings(pattern)}
#: One alternation of all spellings, the longer first; nothing that would make a word of it may follow.
SPELLING = rf"(?:{'|'.join(sorted((a[0] for a in ALIASES), key=lambda p: (-max(map(len, spellings(p))), p)))})(?![a-zа-я0-9])"


def unit_of(spelling: Column) -> Column:
    """Key of the unit that a text matched by ``SPELLING`` stands for, else null."""
    return _lookup({s: key for s, (key, _) in SPELT.items()}, F.regexp_replace(F.lower(spelling), r"[\s.]", ""))


def is_weak(spelling: Column) -> Column:
    """Whether a unit's spelling is a letter that may well be none."""
    return F.regexp_replace(F.lower(spelling), r"[\s.]", "").isin(*[s for s, (_, weak) in SPELT.items() if weak])


def unit_after(text: Column) -> Column:
    """(unit, weak, length) of the longest spelling at the start of ``text``, after one space at most; null if none."""
    hit = F.regexp_extract(text, f"(?iu)^ ?{SPELLING}", 0)
    return F.when(hit != "", F.struct(unit_of(hit).alias("unit"), is_weak(hit).alias("weak"), F.length(hit).alias("length")))


# ------------------------------------------------------------- kernel twins
_PATTERNS = [(re.compile(r"[ ]?(?:" + p + r")(?![a-zа-я0-9])", re.IGNORECASE), k, w) for p, k, w in ALIASES]


@lru_cache(maxsize=100_000)
def _at_start(rest: str) -> tuple[str, int, bool] | None:
    best = None
    for pattern, key, weak in _PATTERNS:
        m = pattern.match(rest)
        if m and (best is None or (m.end(), not weak) > (best[1], not best[2])):
            best = (key, m.end(), weak)
    return best


def plain_unit_at(text: str, place: int) -> tuple[Unit, int, bool] | None:
    """(unit, end, weak) of the longest spelling at ``place``."""
    found = _at_start(text[place : place + 40])
    return (UNITS[found[0]], place + found[1], found[2]) if found else None


def plain_okei(name: str | None) -> Unit | None:
    key = OKEI.get(" ".join((name or "").lower().replace("ё", "е").split()))
    return UNITS[key] if key else None


def plain_convert(value: float, source: Unit, target: Unit) -> float | None:
    return value * source.factor / target.factor if source.dimension == target.dimension else None
