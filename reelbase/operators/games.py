"""Game cartridges: fixed headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import part, starts
from ..sources.registry import LOGO_GB, LOGO_GBA, snes_header
from .pick import by_file, head, words


def gameboy_kind(b: Column) -> Column:
    return F.when(starts(b, LOGO_GBA, 4) & starts(b, b"\x96", 178), "gba").when(starts(b, LOGO_GB, 260), F.when(starts(b, b"\x80", 323), "gbc").otherwise("gb"))


def gameboy_title(b: Column) -> Column:
    return words(F.when(starts(b, LOGO_GBA, 4), part(b, 160, 12)).otherwise(part(b, 308, 15)))


def gameboy(e: DataFrame) -> DataFrame:
    kinds = {"gb": "GameBoy game", "gbc": "GameBoyColour game", "gba": "GameBoyAdvance game"}
    m = by_file(e, kind=head(gameboy_kind), title=head(gameboy_title))
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return m.select("*", F.concat(F.lit("games/"), "kind").alias("mime"), F.try_element_at(name, F.col("kind")).alias("type")).drop("kind")


def snes(e: DataFrame) -> DataFrame:
    m = by_file(e, title=head(lambda b: F.trim(F.decode(part(snes_header(b), 0, 21), "ISO-8859-1"))))
    return m.select("*", F.lit("games/snes").alias("mime"), F.lit("SNES game").alias("type"))


MEDIA = {"gameboy": gameboy, "snes": snes}
