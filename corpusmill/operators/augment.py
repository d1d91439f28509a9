"""Random changes of texts, the same for the same seed and id however rows are spread."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..errors import ConfigError
from ..functions.ranks import hash_key, uniform
from ..functions.text import WORD
from ..registry import NUMBER, Config, operator, option

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def coin(seed: str, key: Column, place: Column) -> Column:
    return uniform(hash_key(seed, F.concat_ws(":", key, place.cast("string"))))


def _swap(seed: str, key: Column, word: str, options: list[str]) -> Callable[[Column, Column], Column]:
    def swap(w: Column, i: Column) -> Column:
        u = coin(seed, key, i) * (len(options) + 1)
        same = F.translate(w, _UPPER, _LOWER) == word.translate(str.maketrans(_UPPER, _LOWER))
        pick = reduce(lambda rest, j: F.when(u < j + 1, options[j]).otherwise(rest), reversed(range(len(options))), w)
        return F.when(same, pick).otherwise(w)

    return swap


@operator("augment.synonym", row_wise=True)
def synonym(ds: Dataset, config: Config) -> Dataset:
    """Each occurrence of a word, whatever its case, becomes one of its n replacements, all as likely as itself. Words end up a space apart."""
    path, seed = option(config, "path", kinds=str), option(config, "seed", 0, int)
    entries = []
    for e in option(config, "synonyms", kinds=list):
        options = [r for r in option(e, "replacements", kinds=list) if isinstance(r, str)]
        if not options:
            raise ConfigError("a synonym needs replacements")
        entries.append((option(e, "word", kinds=str), options))
    c = ds.text(path)
    if c is None or not entries:
        return ds
    words = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    for n, (word, options) in enumerate(entries):
        words = F.transform(words, _swap(f"{seed}:{n}", ds.key(), word, options))
    return ds.put(path, F.array_join(words, " "))


@operator("augment.noise", row_wise=True)
def noise(ds: Dataset, config: Config) -> Dataset:
    """ASCII letters change their case and digits go up by one, each with probability intensity."""
    path, seed = option(config, "path", kinds=str), option(config, "seed", 0, int)
    intensity = option(config, "intensity", 0.1, NUMBER)
    if not 0 <= intensity <= 1:
        raise ConfigError("intensity must lie between 0 and 1")
    c = ds.text(path)
    if c is None:
        return ds
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    source, target = _UPPER + _LOWER + "0123456789", _LOWER + _UPPER + "1234567890"
    noisy = F.transform(chars, lambda ch, i: F.when(coin(str(seed), ds.key(), i) < intensity, F.translate(ch, source, target)).otherwise(ch))
    return ds.put(path, F.array_join(noisy, ""))
