"""An invented catalogue, large enough for names to have weight."""

from __future__ import annotations

from pyspark.sql import SparkSession

from nomenclia.plans.analysis import Catalog

STUL, HAMMER = "Стул ученический", "Молоток столярный"
TYPE, HEIGHT, MASS, LENGTH = "Тип каркаса", "Регулировка по высоте", "Масса молотка", "Длина рукоятки"
FIRST = "насос клапан кабель провод лампа фонарь датчик счетчик экран монитор принтер сканер ковер матрац одеяло подушка ведро лопата грабли топор".split()
SECOND = "садовый бытовой уличный настенный переносной складной цифровой оптический резиновый стальной".split()


def catalog(spark: SparkSession) -> Catalog:
    positions, options = [], []

    def position(code: str, name: str, template: bool = False, group: str = "Прочее") -> None:
        positions.append((code, name, code[:8], group, template))

    def quality(code: str, char: str, *labels: str, required: bool = True) -> None:
        options.extend((code, char, required, 1, 1, 1, "quality", x, None, None, None, None, True, True) for x in labels)

    def between(code: str, char: str, label: str, unit: str, low: float, high: float) -> None:
        options.append((code, char, True, 2, 2, 1, "range", label, unit, None, low, high, True, False))

    for code, frame, height in (("31.01.11.150-00000005", "Деревянный", "Нет"), ("31.01.11.150-00000006", "Деревянный", "Да"), ("X-STUL-M1", "Металлический", "Нет"), ("X-STUL-M2", "Металлический", "Да")):
        position(code, STUL, group="Мебель школьная")
        quality(code, TYPE, frame)
        quality(code, HEIGHT, height)
    position("X-STUL-T", STUL, True, "Мебель школьная")
    quality("X-STUL-T", TYPE, "Деревянный", "Металлический")
    quality("X-STUL-T", HEIGHT, "Да", "Нет")
    for code, label, low, high in (("25.73.30.141-00000010", "≥ 0,4 и < 0,6 Килограмм", 0.4, 0.6), ("X-MOL-2", "≥ 0,6 и < 1 Килограмм", 0.6, 1.0)):
        position(code, HAMMER, group="Инструмент ручной")
        between(code, MASS, label, "Килограмм", low, high)
        between(code, LENGTH, "≥ 300 и < 400 Миллиметр", "Миллиметр", 300.0, 400.0)
    position("X-MOL-3", "Молоток слесарный", group="Инструмент ручной")
    between("X-MOL-3", LENGTH, "≥ 250 и < 400 Миллиметр", "Миллиметр", 250.0, 400.0)
    position("X-SHK-1", "Шкаф для одежды", group="Мебель прочая")
    quality("X-SHK-1", "Материал", "Металл")
    for a in FIRST:
        for b in SECOND:
            position(f"F-{a}-{b}", f"{a} {b}")
    supplier = [("Стулья офисные", "Цвет обивки", "Строковая", None), ("Стулья офисные", "Трехместный", "Признак", None)]
    return Catalog(
        spark.createDataFrame(positions, "code string, name string, okpd2_code string, okpd2_name string, is_template boolean"),
        spark.createDataFrame(options, "code string, char string, required boolean, kind int, char_type int, choice_type int, option_kind string, label string, unit string, number double, lower double, upper double, lower_inc boolean, upper_inc boolean"),
        spark.createDataFrame(supplier, "category string, name string, kind string, unit string"),
    )
