"""Column names of any kind: repair as R does it, and dots inside operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Private-use characters that stand for a dot and a backtick while an operator runs.
_STAND_INS = {".": "", "`": ""}
_INSIDE = str.maketrans(_STAND_INS)
_OUTSIDE = str.maketrans({v: k for k, v in _STAND_INS.items()})
#: Fixed by R: words that are no names.
RESERVED = (
    "if else repeat while function for next break TRUE FALSE NULL Inf NaN NA "
    "NA_integer_ NA_real_ NA_character_ NA_complex_ in"
).split()


def make_name(name: str | None) -> str:
    """One syntactic name: letters, digits, dots and underscores behind a letter or a dot.

    Anything else becomes a dot; X goes in front where the start is not allowed (a digit, an
    underscore, a dot and a digit, nothing); a reserved word gets a dot at the end.
    """
    name = "NA" if name is None else name
    start = name[:1]
    allowed = start.isalpha() or (start == "." and not name[1:2].isdigit())
    fixed = "".join(c if c.isalnum() or c in "._" else "." for c in (name if allowed else "X" + name))
    return fixed + "." if fixed in RESERVED else fixed


def make_names(names: Sequence[str | None]) -> list[str]:
    """Syntactic names that differ: repeats get .1, .2 ... , passing over names in use."""
    fixed = [make_name(n) for n in names]
    used, met, out = set(fixed), {}, []
    for name in fixed:
        if name not in met:
            met[name] = 0
            out.append(name)
            continue
        while True:
            met[name] += 1
            new = f"{name}.{met[name]}"
            if new not in used:
                break
        used.add(new)
        out.append(new)
    return out


def _leaves(x) -> Iterator:
    if isinstance(x, Mapping):
        for k, v in x.items():
            yield from (*_leaves(k), *_leaves(v))
    elif isinstance(x, (list, tuple)):
        for v in x:
            yield from _leaves(v)
    else:
        yield x


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets an operator take tables whose column names hold dots or backticks.

    Inside, such names have stand-ins without them; every argument that is one of these
    names is replaced likewise, alone or in a list or mapping. The result gets the real
    names back, in its column names and in text that the operator made of names. Given an
    expression, which names columns in its own way, the operator runs as it is.
    """

    @wraps(operator)
    def called(*args, **options):
        every = [*_leaves(args), *_leaves(options)]
        names = {c for t in every if isinstance(t, DataFrame) for c in t.columns}
        odd = {c: c.translate(_INSIDE) for c in names if c != c.translate(_INSIDE)}
        if not odd or any(isinstance(x, Column) for x in every):
            return operator(*args, **options)

        def inside(x):
            if isinstance(x, DataFrame):
                return x.toDF(*[odd.get(c, c) for c in x.columns])
            if isinstance(x, str):
                return odd.get(x, x)
            if isinstance(x, Mapping):
                return {inside(k): inside(v) for k, v in x.items()}
            return type(x)(map(inside, x)) if isinstance(x, (list, tuple)) else x

        result = operator(*[inside(a) for a in args], **{k: inside(v) for k, v in options.items()})
        given = {odd.get(c, c) for c in names}
        marks, plain = "".join(_STAND_INS.values()), "".join(_STAND_INS)
        texts = [f.name for f in result.schema if f.name not in given and isinstance(f.dataType, T.StringType)]
        result = result.withColumns({c: F.translate(F.col(c), marks, plain) for c in texts})
        return result.toDF(*[c.translate(_OUTSIDE) for c in result.columns])

    return called
