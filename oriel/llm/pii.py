"""Personal data: detected entities get keyed surrogates of the same type, script and format.

Types: email, secret (access keys by their prefixes, long hex strings), ip, ip6, iban, card,
ssn, phone, and the parts of names: given (with a gender) and family. A name is found behind a
form of address, which tells the gender or leaves it open; the same name and its family part
alone are then found in all of that text. Other bare names stay: nothing tells them from words.
Card numbers and IBANs count only if their check digits hold.

What mentions share is their canonical form: an address in lower case, the digits of a number,
a part of a name in lower case, a secret as it is. A surrogate is drawn from SHA-512 of (key,
type, canonical form, attempt), so equal entities get equal surrogates in all documents: a
family keeps one name with and without the given name. It is written in the format of the
mention: the same separators, letters of the same script and case at each place, prefixes of
keys, top-level domains, country codes and valid check digits kept.

Collision checks run over the distinct entities of all documents: an entity whose surrogate is
another's, or is itself an entity, takes its next attempt. From attempt `WIDEN` on each attempt
adds a character, syllable or octet, so the space outgrows any number of entities and the
rounds end; only then does a surrogate get longer than its entity. Attempts above 0 are few;
only documents with such an entity need a join, the others are rewritten where they lie. All of
it is SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import fresh
from oriel.session import stage
from oriel.sources import read_table

KEY = "surrogates"
#: Attempts from here on make longer surrogates.
WIDEN = 3
#: Rows of attempts that may be sent to every executor; more are joined by a shuffle.
MOST_SENT = 10_000

# Forms of address by gender, particles of names, prefixes of keys, and names by gender and script.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "Госпожа"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
PARTICLES = ("von", "van", "de", "der", "den", "zu", "di", "da", "del", "della", "la", "le", "bin", "ibn", "al", "dos", "ter")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "pk-", "xoxb-", "xoxp-", "AIza")
NAMES = {
    "m": ("Albert", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    "f": ("Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    "n": ("Alex", "Ariel", "Bo", "Charlie", "Dana", "Eli", "Jo", "Kim", "Lou", "Mika", "Noa", "Quinn", "Robin", "Sascha", "Sam", "Toni"),
    "m_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Юрий"),
    "f_cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
    "n_cyrillic": ("Саша", "Женя", "Валя", "Слава", "Шура", "Паша", "Миша", "Ася", "Лёша", "Гоша", "Тоша", "Даня", "Сеня", "Тёма", "Юра", "Рома"),
}
SYLLABLES = ("ba", "de", "fi", "go", "ha", "je", "ki", "lo", "ma", "ne", "pi", "ro", "sa", "te", "vi", "zo")
SYLLABLES_CYRILLIC = ("ба", "де", "фи", "го", "ха", "же", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "ви", "зо")

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TITLE = rf"(?:(?:{'|'.join(sorted(sum(TITLES.values(), ()), key=len, reverse=True))})\.? )"
WORD_OF_NAME = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+)"
#: First come, first served: what one of these matches is no part of a later match.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": rf"(?<![\p{{L}}\p{{N}}])(?:(?=[a-f]*[0-9])[0-9a-f]{{32,64}}|(?=[A-F]*[0-9])[0-9A-F]{{32,64}}|(?:{'|'.join(KEY_PREFIXES)})[A-Za-z0-9_-]{{16,96}})(?![\p{{L}}\p{{N}}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?<!ersion )(?<!elease ){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+?(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,5})){2,5})(?![0-9])",
    "name": rf"(?<!\p{{L}}){TITLE}+{WORD_OF_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{WORD_OF_NAME}){{0,3}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with an entity has: a digit, or one of these.
SIGNS = ("@", *KEY_PREFIXES, *sum(TITLES.values(), ()))
DIGIT, LETTERS = "[^0-9]", r"[\p{L}\p{M}]"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: tuple[str, ...]) -> str:
    return f"array({', '.join(_sql(w) for w in words)})"


def _byte(stream: str, i: str) -> str:
    """SQL for the byte number i, from 0, of a stream of 64 in hex; it goes round."""
    return f"cast(conv(substr({stream}, 1 + 2 * (({i}) % 64), 2), 16, 10) as int)"


def _pick(letters: str, byte: str) -> str:
    return f"substr({_sql(letters)}, 1 + {byte} % {len(letters)}, 1)"


def _like(text: str, stream: str, hexed: bool = False) -> str:
    """SQL for text with its letters and digits replaced by others of their kind."""
    b, c = _byte(stream, "i - 1"), f"substr({text}, i, 1)"
    kinds = [("[0-9]", "0123456789"), ("[A-F]", "ABCDEF"), ("[a-f]", "abcdef")] if hexed else [("[0-9]", "0123456789"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")]
    cases = " ".join(f"when {c} rlike {_sql(f'^{kind}$')} then {_pick(letters, b)}" for kind, letters in kinds)
    return f"if(length({text}) = 0, '', array_join(transform(sequence(1, length({text})), i -> case {cases} else {c} end), ''))"


def _draws(letters: str, count: str, stream: str, first: int = 0) -> str:
    """SQL for that many of the letters; none for 0."""
    return f"if({count} < 1, '', array_join(transform(sequence(1, greatest({count}, 1)), i -> {_pick(letters, _byte(stream, f'i + {first}'))}), ''))"


def _luhn(digits: str) -> str:
    """SQL for the check sum of digits, counted from the last, which isn't doubled."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _mod97(text: str) -> str:
    """SQL for the remainder of the number that digits and capital letters (10 to 35) make."""
    c = f"substr({text}, i, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (s, i) -> if({c} rlike '^[0-9]$', (s * 10 + ascii({c}) - 48) % 97, (s * 100 + ascii({c}) - 55) % 97))"


def type_of(m: str) -> str:
    """SQL for the type of a mention: the first pattern that it matches whole; a name without its form of address matches none."""
    return "case " + " ".join(f"when {m} rlike {_sql(f'^(?:{p})$')} then '{t}'" for t, p in PATTERNS.items()) + " else 'name' end"


def holds(m: str, t: str) -> str:
    """SQL for whether a mention's check digits hold, if its type has any."""
    digits, signs = f"regexp_replace({m}, '{DIGIT}', '')", f"replace({m}, ' ', '')"
    return f"case {t} when 'card' then {_luhn(digits)} % 10 = 0 when 'iban' then {_mod97(f'concat(substr({signs}, 5), left({signs}, 4))')} = 1 else true end"


def gender_of(m: str) -> str:
    """SQL for the gender that forms of address tell: f, m, or n for none of both."""
    has = lambda g: f"{m} rlike {_sql('(?:^| )(?:' + '|'.join(TITLES[g]) + ')[. ]')}"
    return f"case when {has('f')} then 'f' when {has('m')} then 'm' else 'n' end"


def bare(m: str) -> str:
    """SQL for a name without forms of address."""
    return f"regexp_replace({m}, {_sql(f'^{TITLE}+')}, '')"


def canonical(m: str, t: str) -> str:
    """SQL for the canonical form of a mention that isn't a name."""
    digits = f"regexp_replace({m}, '{DIGIT}', '')"
    return f"""case {t} when 'email' then lower({m}) when 'ip6' then lower({m}) when 'iban' then replace({m}, ' ', '') when 'card' then {digits} when 'ssn' then {digits}
        when 'phone' then if(length({digits}) = 11 and startswith({digits}, '1'), substr({digits}, 2), {digits}) else {m} end"""


def surrogate(key: str, t: str, c: str, attempt: str) -> str:
    """SQL for the surrogate's canonical form."""
    stream = f"sha2(concat_ws('|', {_sql(key)}, {t}, {c}, {attempt}), 512)"
    extra, cyrillic = f"greatest(0, {attempt} - {WIDEN - 1})", f"{c} rlike {_sql(r'\p{IsCyrillic}')}"
    host = f"substring_index({c}, '@', -1)"
    numbers, small = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    keyed = f"sha2(concat_ws('|', {_sql(key)}, 'domain', {host}), 512)"
    email = f"concat({_like(f"substring_index({c}, '@', 1)", 'x')}, {_draws(small, extra, 'x', 20)}, '@', {_like(f"regexp_replace({host}, '[.][^.]*$', '')", keyed)}, '.', substring_index({host}, '.', -1))"
    prefix = f"regexp_extract({c}, {_sql('^(' + '|'.join(KEY_PREFIXES) + ')')}, 1)"
    secret = f"concat(if({c} rlike '^([0-9a-f]+|[0-9A-F]+)$', {_like(c, 'x', True)}, concat({prefix}, {_like(f'substr({c}, 1 + length({prefix}))', 'x')})), {_draws(numbers, extra, 'x', 20)})"
    octets = f"concat(array_join(transform(sequence(0, 3 + {extra}), i -> {_byte('x', 'i')} + if(i = 0 and {_byte('x', 'i')} = 0, 1, 0)), '.'))"
    card = f"transform(array(concat(left({c}, 1), {_draws(numbers, f'length({c}) - 2 + {extra}', 'x')})), y -> concat(y, (10 - {_luhn('concat(y, 0)')} % 10) % 10))[0]"
    account = f"transform(array(concat({_like(f'substr({c}, 5)', 'x')}, {_draws(numbers, extra, 'x', 40)})), y -> concat(left({c}, 2), lpad(98 - {_mod97(f"concat(y, left({c}, 2), '00')")}, 2, '0'), y))[0]"
    phone = f"if(length({c}) > 10, concat(left({c}, 2), {_draws(numbers, f'length({c}) - 2 + {extra}', 'x')}), {_draws(numbers, f'length({c}) + {extra}', 'x')})"
    syllables = lambda count, first: f"array_join(transform(sequence(1, {count}), i -> if({cyrillic}, {_array(SYLLABLES_CYRILLIC)}, {_array(SYLLABLES)})[{_byte('x', f'i + {first}')} % 16]), '')"
    given = "case right(" + t + ", 1) " + " ".join(f"when '{g}' then if({cyrillic}, {_array(NAMES[g + '_cyrillic'])}, {_array(NAMES[g])})" for g in "mfn") + " end"
    made = f"""case when {t} = 'email' then {email} when {t} = 'secret' then {secret} when {t} = 'ip' then {octets} when {t} = 'card' then {card} when {t} = 'iban' then {account}
        when {t} = 'ip6' then concat({_like(c, 'x', True)}, if({extra} > 0, concat(':', {_draws("0123456789abcdef", extra, 'x', 40)}), ''))
        when {t} = 'ssn' then {_draws(numbers, f'9 + {extra}', 'x')} when {t} = 'phone' then {phone}
        when {t} = 'family' then {syllables(f'4 + {extra}', 0)} else concat(lower({given}[{_byte('x', '0')} % 16]), if({attempt} = 0, '', {syllables(f'greatest(1, {attempt})', 0)})) end"""
    return f"transform(array({stream}), x -> {made})[0]"


def cased(m: str, s: str) -> str:
    """SQL for s with capital letters where m has them; what is longer follows the last letter."""
    c = f"substr({m}, least(i, length({m})), 1)"
    return f"array_join(transform(sequence(1, length({s})), i -> if({c} != lower({c}), upper(substr({s}, i, 1)), substr({s}, i, 1))), '')"


def written_like(m: str, t: str, s: str) -> str:
    """SQL for the surrogate s in the format of the mention m that isn't a name."""
    own = lambda signs: f"length(regexp_replace({m}, '[^{signs}]', ''))"

    def fill(signs: str, size: str) -> str:
        """The last `size` signs of m become the first of s; what s has more follows."""
        return f"""aggregate(sequence(1, length({m})), named_struct('out', '', 'k', {size} - {own(signs)} + 1), (z, i) -> if(substr({m}, i, 1) rlike '^[{signs}]$',
            named_struct('out', concat(z.out, if(z.k >= 1, substr({s}, z.k, 1), substr({m}, i, 1))), 'k', z.k + 1), named_struct('out', concat(z.out, substr({m}, i, 1)), 'k', z.k)), z -> concat(z.out, substr({s}, {size} + 1)))"""

    part = lambda x, k: f"substring_index({x}, '@', {k})"
    size = f"if({t} = 'phone', length({canonical(m, "'phone'")}), {own('0-9')})"
    return f"""case when {t} = 'email' then concat({cased(part(m, 1), part(s, 1))}, '@', {cased(part(m, -1), part(s, -1))}) when {t} in ('phone', 'card', 'ssn') then {fill('0-9', size)}
        when {t} = 'iban' then {fill('A-Z0-9', own('A-Z0-9'))} when {t} = 'ip6' then {cased(m, s)} else {s} end"""


def parts_of(name: str, gender: str) -> str:
    """SQL for an array of structs (p, t): the pieces of a bare name in order, with their type, null for what stays (separators, particles, single letters)."""
    pieces = f"regexp_extract_all(w.w, {_sql(f'{LETTERS}+|[^\\p{{L}}\\p{{M}}]+')}, 0)"
    role = f"if(w.k = size(split({name}, ' ')) - 1, 'family', concat('given ', {gender}))"
    typed = f"transform({pieces}, p -> named_struct('p', p, 't', if(p rlike {_sql(rf'^{LETTERS}{{2,}}$')} and w.w rlike {_sql(r'^\p{Lu}')}, {role}, null)))"
    words = f"transform(split({name}, ' '), (w, k) -> named_struct('w', w, 'k', k))"
    return f"flatten(transform({words}, w -> concat(if(w.k > 0, array(named_struct('p', ' ', 't', cast(null as string))), array()), {typed})))"


def may_have(text: Column) -> Column:
    """Texts without a digit or sign are passed over by plain searches."""
    may = text.rlike("[0-9]")
    for sign in SIGNS:
        may = may | F.contains(text, F.lit(sign))
    return may


def with_mentions(rows: DataFrame, text: str, pattern: str, found: str) -> DataFrame:
    """rows with two more columns: the pattern of its entities, and the mentions in order.

    A mention is a struct (m, t, ps): the text, the type (null if its check digits don't hold),
    and of a name its pieces. The pattern is ENTITY and, if the text has names with a form of
    address, these names without it.
    """
    none = "cast(array() as array<string>)"
    first = F.when(may_have(F.col(text)), F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0)))
    named = rows.withColumn(found, first)
    names = f"transform(filter(`{found}`, m -> m rlike {_sql('^' + TITLE)} and {type_of('m')} = 'name'), m -> named_struct('b', {bare('m')}, 'g', {gender_of('m')}))"
    known = fresh(named, "_known")
    named = named.withColumn(known, F.expr(f"if(size(`{found}`) > 0, array_distinct({names}), array())"))
    alone = f"array_sort(filter(array_distinct(flatten(transform(`{known}`, n -> array(n.b, regexp_extract(n.b, '[^ ]+$', 0))))), b -> length(b) > 2), (a, b) -> length(b) - length(a))"
    named = named.withColumn(pattern, F.expr(f"if(size(`{known}`) > 0, concat({_sql(ENTITY + r'|(?<!\p{L})(?=\p{Lu})(?:')}, array_join(transform({alone}, b -> concat('\\\\Q', b, '\\\\E')), '|'), {_sql(r')(?!\p{L})')}), {_sql(ENTITY)})"))
    again = F.when(F.size(known) > 0, F.regexp_extract_all(F.col(text), F.col(pattern), F.lit(0))).otherwise(F.col(found))
    named = named.withColumn(found, again)
    gender = f"if(m.m rlike {_sql('^' + TITLE)}, {gender_of('m.m')}, coalesce(filter(`{known}`, n -> n.b = m.m)[0].g, 'n'))"
    shaped = f"transform(transform(coalesce(`{found}`, {none}), m -> named_struct('m', m, 't', {type_of('m')})), m -> named_struct('m', m.m, 't', if({holds('m.m', 'm.t')}, m.t, null), 'ps', if(m.t = 'name', {parts_of(bare('m.m'), gender)}, null)))"
    return named.withColumn(found, F.expr(shaped)).drop(known)


def entities_of(found: str) -> str:
    """SQL for an array of structs (type, canonical) of mentions as with_mentions() gives them."""
    whole = f"array(named_struct('type', m.t, 'canonical', {canonical('m.m', 'm.t')}))"
    parts = "transform(filter(m.ps, p -> p.t is not null), p -> named_struct('type', p.t, 'canonical', lower(p.p)))"
    return f"flatten(transform(filter({found}, m -> m.t is not null), m -> if(m.t = 'name', {parts}, {whole})))"


def entities(texts: DataFrame) -> DataFrame:
    """Distinct rows (type, canonical) of the mentions in a column text."""
    return with_mentions(texts.select("text"), "text", "_pattern", "_found").selectExpr(f"inline({entities_of('_found')})").distinct()


def settle(found: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (type, canonical, attempt, surrogate) in which no surrogate is another's or an entity; given names of all genders count together.

    Every round gives the next attempt to those in the way, the first in order of (attempt,
    canonical, type) keeps its own. Attempts widen the space, so the rounds end for any input.
    """
    drawn = lambda rows: stage(rows.withColumn("surrogate", F.expr(surrogate(key, "type", "canonical", "attempt"))).withColumn("space", F.substring_index("type", " ", 1)), "surrogates")
    settled = drawn(found.withColumn("attempt", F.lit(0)))
    order = F.struct("attempt", "canonical", "type")
    while True:
        shared = settled.groupBy("space", "surrogate").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("space", "surrogate", "first")
        twice = settled.join(shared, ["space", "surrogate"]).where(order != F.col("first")).select("type", "canonical")
        names = settled.select("space", F.col("canonical").alias("surrogate"))
        taken = settled.join(names, ["space", "surrogate"], "left_semi").select("type", "canonical")
        moved = stage(twice.union(taken).distinct(), "collisions")
        if moved.isEmpty():
            return settled.drop("space")
        up = settled.join(moved.withColumn("up", F.lit(1)), ["type", "canonical"], "left").select("type", "canonical", (F.col("attempt") + F.coalesce("up", F.lit(0))).alias("attempt"))
        settled = drawn(up)


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with text_col rewritten, and n_entities (long), the mentions replaced.

    A null text stays null and has none; an empty one stays empty. Equal mentions get equal
    surrogates, in repeated rows too. A column n_entities of docs itself is replaced.
    """
    docs = docs.drop("n_entities")
    pattern, found, made, own, tries = (fresh(docs, x) for x in ("_pattern", "_found", "_made", "_own", "_tries"))
    settled = settle(entities(docs.select(docs[text_col].alias("text"))), key)
    again = stage(settled.where("attempt > 0").select("type", "canonical", "attempt"), "attempts")
    listed = with_mentions(docs, text_col, pattern, found)
    few, attempt = again.limit(MOST_SENT + 1).count(), lambda t, c: "0"
    if few:
        texts = with_mentions(docs.select(docs[text_col].alias("text")).where("text is not null"), "text", "_pattern", "_found")
        mentions = texts.withColumn("own", F.xxhash64("text")).selectExpr("own", f"inline({entities_of('_found')})")
        hit = mentions.join(F.broadcast(again) if few <= MOST_SENT else again, ["type", "canonical"])
        # Attempts of one text's entities; should two texts share a hash, one map serves both.
        hit = hit.groupBy("own").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "type", "canonical"), "attempt"))).alias(tries)).withColumnRenamed("own", own)
        hit = stage(hit, "text-attempts")
        small = hit.limit(MOST_SENT + 1).count() <= MOST_SENT
        listed = listed.join(F.broadcast(hit) if small else hit, F.xxhash64(listed[text_col]) == hit[own], "left").drop(own)
        attempt = lambda t, c: f"coalesce(`{tries}`[concat_ws('|', {t}, {c})], 0)"
    whole = f"transform(array(named_struct('m', m.m, 't', m.t, 'c', {canonical('m.m', 'm.t')})), e -> transform(array({surrogate(key, 'e.t', 'e.c', attempt('e.t', 'e.c'))}), v -> {written_like('e.m', 'e.t', 'v')})[0])[0]"
    piece = f"transform(array({surrogate(key, 'p.t', 'lower(p.p)', attempt('p.t', 'lower(p.p)'))}), v -> if(p.p = upper(p.p), upper(v), initcap(v)))[0]"
    name = f"concat(regexp_extract(m.m, {_sql(f'^{TITLE}+')}, 0), array_join(transform(m.ps, p -> if(p.t is null, p.p, {piece})), ''))"
    new = f"transform(`{found}`, m -> case when m.t is null then m.m when m.t = 'name' then {name} else {whole} end)"
    rewritten = listed.withColumn(made, F.when(F.size(found) > 0, F.expr(new)))
    text = F.when(F.size(found) > 0, F.expr(f"array_join(zip_with(split(`{text_col}`, `{pattern}`, -1), `{made}`, (g, n) -> concat(g, coalesce(n, ''))), '')")).otherwise(F.col(text_col))
    count = F.expr(f"cast(size(filter(`{found}`, m -> m.t is not null)) as long)")
    return rewritten.withColumn(text_col, text).withColumn("n_entities", count).drop(pattern, found, made, tries)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace_entities() of all documents; nulls, empty texts and repeated rows as there."""
    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
