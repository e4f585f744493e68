"""Formatters and texts of the reports. The words are the reports' own, in Turkish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reports say for a status, a kind, a part of an error's text.
STATUS = {"Succeeded": ("ok", "Başarılı"), "Running": ("run", "Sürüyor"), "Pending": ("pending", "Bekliyor"), "Warning": ("warn", "Uyarı"), "Failed": ("err", "Hata"), "Cancelled": ("muted", "İptal edildi"), "Locked": ("locked", "Korumalı")}
KINDS = {"backup": "Yedekleme", "verify": "Doğrulama", "prune": "Budama"}
TITLES = {"not enabled for unattended access": "Depo gözetimsiz erişime açık değil", "is denied": "Bir yol okunamadı", "being used by another process": "Bir dosya kilitliydi", "anomaly": "Olağandışı değişim tespit edildi"}
#: What a job says that a stop of the service ended. Fixed value.
STOPPED = "Cancelled (service stopping)."
OTHER_TITLE, NO_ERROR = "Yedekleme tamamlanamadı", "Bilinmeyen hata"
EXPLANATIONS = {
    "not enabled for unattended access": "Zamanlanmış işler parolayı soramaz; depoyu açmak için makineye bağlı bir anahtar gerekir. Depolar sayfasında bu depo için parolasız (servis) erişimi açın.",
    "is denied": "Servis hesabının bu yola okuma izni yok. Yolu plandan çıkarın ya da hesaba okuma izni verin. Tek tek okunamayan dosyalar artık yedeklemeyi durdurmaz, yalnızca atlanır.",
    "being used by another process": "Dosya başka bir işlem tarafından açık tutuluyordu. VSS ile yedekleme açık dosyaları da alabilir.",
    "anomaly": "Bu çalışmada beklenenden çok daha fazla dosya değişti veya silindi. Fidye yazılımı olasılığına karşı iş durduruldu ve hiçbir şey deponun içine yazılmadı.",
}
OTHER_EXPLANATION = "İşin ham hata metni aşağıdadır."


def _first(key: Column, table: dict[str, str], other: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, other)


def _first_within(text: Column, table: dict[str, str], other: str) -> Column:
    """The entry whose key is the first of the table's within the text, in any case."""
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)).otherwise(out)
    return out


def status_css(status: Column) -> Column:
    return _first(status, {k: v[0] for k, v in STATUS.items()}, F.lit("muted"))


def status_text(status: Column) -> Column:
    return _first(status, {k: v[1] for k, v in STATUS.items()}, status)


def kind_text(kind: Column) -> Column:
    return _first(kind, KINDS, kind)


def error_title(raw: Column) -> Column:
    return _first_within(raw, TITLES, OTHER_TITLE)


def error_explanation(raw: Column) -> Column:
    return _first_within(raw, EXPLANATIONS, OTHER_EXPLANATION)


def number(value: Column) -> Column:
    """Whole numbers with points between thousands."""
    return F.translate(F.format_number(value.cast("bigint"), 0), ",", ".")


def byte_size(value: Column) -> Column:
    """Steps of 1024 up to TB; one decimal but for B."""
    v = value.cast("double")
    out = F.translate(F.format_number(F.round(v / 1024.0**4, 1), 1), ",.", ".,")
    out = F.concat(out, F.lit(" TB"))
    for i, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(v < 1024.0 ** (i + 1), F.concat(F.translate(F.format_number(F.round(v / 1024.0**i, 1), 1), ",.", ".,"), F.lit(f" {unit}"))).otherwise(out)
    return F.when(v < 1024, F.concat(number(value), F.lit(" B"))).otherwise(out)


def date_time(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock time in the zone of those who read the report."""
    return F.date_format(ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "dd.MM.yyyy HH:mm")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def relative(ts: Column, now: Column) -> Column:
    s = F.greatest(F.timestamp_diff("SECOND", ts, now), F.lit(0))
    step = lambda n, unit: F.concat((s / n).cast("bigint").cast("string"), F.lit(f" {unit} önce"))
    day = 86400
    return F.when(s < 60, F.lit("az önce")).when(s < 3600, step(60, "dk")).when(s < day, step(3600, "sa")).when(s < 30 * day, step(day, "gün")).when(s < 365 * day, step(30 * day, "ay")).otherwise(step(365 * day, "yıl"))


def duration(seconds: Column) -> Column:
    """The highest unit that isn't zero and the one below it."""
    parts = [((seconds / 86400).cast("bigint"), "gün"), ((seconds % 86400 / 3600).cast("bigint"), "sa"), ((seconds % 3600 / 60).cast("bigint"), "dk"), ((seconds % 60).cast("bigint"), "sn")]
    text = [F.concat(v.cast("string"), F.lit(f" {u}")) for v, u in parts]
    out = F.when(parts[3][0] > 0, text[3]).otherwise(F.lit("0 sn"))
    for i in (2, 1, 0):
        out = F.when(parts[i][0] > 0, F.concat_ws(" ", text[i], text[i + 1])).otherwise(out)
    return out


def duration_between(start: Column, end: Column) -> Column:
    s = seconds_between(start, end)
    return F.when(s.isNotNull(), duration(s)).otherwise("-")


def truncated_path(path: Column, most: int) -> Column:
    """Middle parts of a long path give way to an ellipsis, and at last its end does."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    hard = lambda x: F.concat(F.substring(x, 1, most - 1), F.lit("…")) if most > 1 else F.lit("…")
    prefix = F.when(path.startswith("\\\\"), F.concat(F.lit("\\\\"), F.get(parts, F.lit(0)))).otherwise(F.get(parts, F.lit(0)))
    short = F.concat_ws("\\", prefix, F.get(parts, F.lit(1)), F.lit("…"), F.element_at(parts, -1))
    return F.when(F.length(path) <= most, path).when(F.size(parts) < 3, hard(path)).when(F.length(short) <= most, short).otherwise(hard(short))


def disk_percent(used: Column, total: Column) -> Column:
    """Rounded half to even; null where the size is unknown or 0."""
    return F.when(total > 0, F.bround(used * 100.0 / total, 0).cast("int"))


def disk_level(percent: Column) -> Column:
    return F.when(percent >= 95, "danger").when(percent >= 85, "warning").when(percent.isNotNull(), "ok")


def verify_level(level: Column) -> Column:
    return F.when(level.isin("Index", "Packs", "Full"), level).otherwise("Packs")


#: id, last, daily, weekly, monthly, yearly. Fixed values; what matches none is "ozel".
PRESETS = (("onerilen", None, 7, 4, 12, None), ("uzun", None, 14, 8, 24, 5), ("kisa", 10, None, None, None, None), ("yok", None, None, None, None, None))
POLICY_PARTS = (("KeepLast", "son {}"), ("KeepDaily", "{} günlük"), ("KeepWeekly", "{} haftalık"), ("KeepMonthly", "{} aylık"), ("KeepYearly", "{} yıllık"))


def retention_summary(policy: Column) -> Column:
    """Of a policy struct as parsed from JSON."""
    parts = []
    for name, form in POLICY_PARTS:
        before, after = form.split("{}")
        parts.append(F.concat(F.lit(before), policy[name].cast("string"), F.lit(after)))
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit("Budanmaz"))


def preset_id(policy: Column) -> Column:
    out = F.lit("ozel")
    for name, *values in reversed(PRESETS):
        same = F.lit(True)
        for (field, _), v in zip(POLICY_PARTS, values, strict=True):
            same = same & policy[field].eqNullSafe(F.lit(v).cast("int"))
        out = F.when(same, name).otherwise(out)
    return F.when(policy.isNull(), "yok").otherwise(out)


def file_time(ft: Column) -> Column:
    """100-ns ticks since 1601 as a timestamp."""
    return F.timestamp_micros((ft / 10).cast("bigint") - 11644473600000000)
