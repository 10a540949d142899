"""The dialect's scalar functions as Spark SQL: a template of the arguments for each number of them.

Every function is JVM-side, so whole-stage code generation and pushdown see through it."""

from __future__ import annotations

#: (name, number of arguments) -> template; {0}, {1}, … are the arguments, already Spark SQL.
TEMPLATES: dict[tuple[str, int], str] = {}


def _add(text: str) -> None:
    for line in filter(None, map(str.strip, text.splitlines())):
        head, template = line.split(" := ", 1)
        name, n = head.split("/")
        TEMPLATES[name, int(n)] = template


_add("""
LOWER/1 := lower({0})
UPPER/1 := upper({0})
INITCAP/1 := aggregate(split({0}, ''), named_struct('o', '', 'up', true), (a, c) -> named_struct('o', concat(a.o, if(a.up, upper(c), lower(c))), 'up', NOT c RLIKE '[0-9A-Za-z]'), a -> a.o)
LEFT/2 := if({1} < 0, raise_error('LEFT needs a size of 0 or more'), left({0}, {1}))
RIGHT/2 := if({1} < 0, raise_error('RIGHT needs a size of 0 or more'), right({0}, {1}))
LPAD/2 := lpad({0}, cast({1} AS int), ' ')
LPAD/3 := lpad({0}, cast({1} AS int), {2})
RPAD/2 := rpad({0}, cast({1} AS int), ' ')
RPAD/3 := rpad({0}, cast({1} AS int), {2})
LTRIM/1 := ltrim({0})
LTRIM/2 := ltrim({1}, {0})
RTRIM/1 := rtrim({0})
RTRIM/2 := rtrim({1}, {0})
REVERSE/1 := reverse({0})
REPEAT/2 := repeat({0}, cast({1} AS int))
REPLACE/3 := replace({0}, {1}, {2})
SUBSTR/2 := substring({0}, cast(greatest({1}, 1) AS int))
SUBSTR/3 := if({2} < 0, raise_error('SUBSTR needs a count of 0 or more'), substring({0}, cast(greatest({1}, 1) AS int), cast(greatest(0, {2} + least({1} - 1, 0)) AS int)))
ASCII/1 := if(length({0}) = 1 AND ascii({0}) < 128, ascii({0}), raise_error('ASCII needs one ASCII character'))
CHR/1 := if({0} BETWEEN 0 AND 255, chr({0}), raise_error('CHR needs 0 to 255'))
MD5/1 := md5({0})
HEX/1 := hex({0})
FIND_IDX/2 := if({1} = '', 0, locate({1}, {0}))
FIND_IDX/3 := if({2} <= 0, raise_error('FIND_IDX needs a start of 1 or more'), locate({1}, {0}, cast({2} AS int)))
POSITION/2 := if({0} = '', 0, locate({0}, {1}))
ABS/1 := abs({0})
SIGN/1 := cast(sign({0}) AS tinyint)
CEIL/1 := cast(ceil({0}) AS double)
FLOOR/1 := cast(floor({0}) AS double)
ROUND/1 := round(cast({0} AS double))
TRUNC/1 := sign({0}) * floor(abs(cast({0} AS double)))
EXP/1 := exp({0})
LN/1 := ln({0})
LOG/2 := log({1}, {0})
LOG2/1 := log2({0})
LOG10/1 := log10({0})
SQRT/1 := sqrt({0})
POWER/2 := power({0}, {1})
SIN/1 := sin({0})
COS/1 := cos({0})
TAN/1 := tan({0})
ASIN/1 := asin({0})
ACOS/1 := acos({0})
ATAN/1 := atan({0})
PI/0 := pi()
RADIANS/1 := radians({0})
DEGREES/1 := degrees({0})
DIV/2 := cast({0} / {1} AS bigint)
MOD/2 := mod({0}, {1})
GCD/2 := aggregate(sequence(1, 93), named_struct('a', abs(cast({0} AS bigint)), 'b', abs(cast({1} AS bigint))), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)
LCM/2 := if({0} = 0 OR {1} = 0, 0L, cast(abs(cast({0} AS decimal(38, 0)) * {1}) / aggregate(sequence(1, 93), named_struct('a', abs(cast({0} AS bigint)), 'b', abs(cast({1} AS bigint))), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a) AS bigint))
RAND/0 := rand()
RAND/1 := pmod(xxhash64(cast({0} AS bigint)), 9007199254740992L) / 9007199254740992D
NOW/0 := localtimestamp()
CURRENT_TIMESTAMP/0 := localtimestamp()
CURRENT_DATE/0 := current_date()
CURRENT_TIME/0 := date_format(localtimestamp(), 'HH:mm:ss.SSSSSS')
FORMAT/2 := date_format({0}, {1})
TO_DATE/2 := to_date({0}, {1})
TO_TIMESTAMP/2 := to_timestamp_ntz({0}, {1})
TO_TIME/2 := date_format(to_timestamp_ntz({0}, {1}), 'HH:mm:ss')
ADD_MONTH/2 := add_months(to_date({0}), cast({1} AS int))
LAST_DAY/1 := last_day({0})
APPEND/2 := if({1} IS NULL, NULL, array_append({0}, {1}))
PREPEND/2 := if({1} IS NULL, NULL, array_prepend({0}, {1}))
SKIP/2 := slice({0}, cast({1} AS int) + 1, greatest(size({0}) - cast({1} AS int), 0))
TAKE/2 := slice({0}, 1, cast({1} AS int))
SLICE/3 := slice({0}, if({1} < 0, greatest(size({0}) + cast({1} AS int), 0), cast({1} AS int)) + 1, cast({2} AS int))
SORT/1 := array_sort({0})
SORT/2 := if(upper({1}) = 'DESC', reverse(array_sort({0})), array_sort({0}))
DEDUP/1 := filter({0}, (x, i) -> i = 0 OR NOT (x <=> get({0}, i - 1)))
SPLICE/3 := concat(slice({0}, 1, cast({1} AS int)), slice({0}, cast({2} AS int) + 1, greatest(size({0}) - cast({2} AS int), 0)))
SPLICE/4 := concat(slice({0}, 1, cast({1} AS int)), {3}, slice({0}, cast({2} AS int) + 1, greatest(size({0}) - cast({2} AS int), 0)))
IS_EMPTY/1 := size({0}) = 0
ENTRIES/1 := transform(array_sort(map_entries({0})), e -> array(e.key, cast(e.value AS string)))
KEYS/1 := array_sort(map_keys({0}))
VALUES/1 := transform(array_sort(map_keys({0})), k -> {0}[k])
IFNULL/2 := ifnull({0}, {1})
NULLIF/2 := nullif({0}, {1})
GENERATE_UUID/0 := uuid()
POINT/2 := named_struct('x', cast({0} AS double), 'y', cast({1} AS double))
GET_X/1 := {0}.x
GET_Y/1 := {0}.y
CALC_DISTANCE/2 := sqrt(power({0}.x - {1}.x, 2) + power({0}.y - {1}.y, 2))
UNWRAP/2 := coalesce(try_variant_get({0}, concat('$', regexp_replace(concat('.', {1}), '[.]([0-9]+)(?=[.]|$)', '[$1]')), 'string'), try_variant_get({0}, concat('$.', {1}), 'string'))
SPLIT/2 := split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)
MAP_OF_JSON/1 := from_json({0}, 'map<string,string>')
""")
ANY = {"COALESCE": "coalesce({})", "CONCAT": "concat({})", "CONCAT_WS": "concat_ws({})", "GREATEST": "greatest({})"}

#: strftime letters and Java's.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "f": "SSSSSS"}


def java_pattern(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            out += STRFTIME.get(text[i + 1], text[i + 1])
            i += 2
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out
