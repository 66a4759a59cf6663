"""What can be told of queries, requests and code by their lines and words. Built-in expressions only."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

from .scalars import contains_any, count_contained

# Results depend on these words.
PATTERN_WORDS = (
    "pattern", "patterns", "caching", "cache", "retry", "retries", "validation", "validate", "authentication", "auth",
    "authorization", "logging", "logs", "monitoring", "health check", "background job", "background task",
    "circuit breaker", "rate limit", "throttling", "pagination", "versioning", "encryption", "best practice",
    "best practices",
)
RELATION_WORDS = (
    "implement", "implements", "implementation", "inherit", "inherits", "inheritance", "extends", "interface", "call",
    "calls", "calling", "use", "uses", "using", "depend", "depends", "dependency", "relationship", "that have",
    "that has", "with attribute", "with annotation",
)
STOP_WORDS = (
    "how", "what", "where", "when", "why", "is", "are", "the", "a", "an", "do", "does", "can", "to", "in", "for", "of",
    "and", "or",
)
DOMAINS = {
    "Authentication": ("auth", "login", "logout", "jwt", "token", "oauth", "identity", "password", "credential", "session", "cookie"),
    "Authorization": ("role", "policy", "permission", "claim", "authorize", "access", "grant", "deny"),
    "Billing": ("payment", "invoice", "subscription", "charge", "billing", "price", "cost", "stripe", "paypal"),
    "Orders": ("order", "cart", "checkout", "purchase", "shipping", "delivery"),
    "Users": ("user", "profile", "account", "registration", "signup", "member"),
    "Products": ("product", "catalog", "inventory", "stock", "item", "sku"),
    "Notifications": ("notification", "email", "sms", "push", "alert", "message", "send"),
    "Logging": ("log", "trace", "debug", "error", "warning", "telemetry", "metrics"),
    "Caching": ("cache", "redis", "memory", "distributed", "invalidate"),
    "DataAccess": ("repository", "dbcontext", "entity", "migration", "query", "sql", "database"),
    "API": ("controller", "endpoint", "rest", "graphql", "swagger", "openapi"),
    "Background": ("background", "job", "worker", "queue", "hangfire", "scheduled", "hosted"),
    "Configuration": ("config", "settings", "options", "appsettings", "environment"),
    "Testing": ("test", "mock", "fixture", "assert", "xunit", "nunit", "fact", "theory"),
}
RELATED = {
    "csharp": ("java", "typescript", "kotlin", "go"),
    "java": ("csharp", "kotlin", "typescript", "go"),
    "kotlin": ("java", "csharp", "typescript", "swift"),
    "python": ("javascript", "typescript", "ruby"),
    "javascript": ("typescript", "python"),
    "typescript": ("javascript", "python", "csharp"),
    "ruby": ("python", "javascript"),
    "go": ("csharp", "java", "rust"),
    "rust": ("go", "csharp"),
    "swift": ("kotlin", "typescript"),
    "dart": ("typescript", "kotlin", "javascript"),
    "fsharp": ("csharp", "haskell"),
}
PROJECT_TYPES = (
    ("MobileApp", ("flutter", "mobile", "app")),
    ("WebAPI", ("api", "endpoint")),
    ("AIAgent", ("agent", "llm", "chat")),
    ("WebApp", ("blazor", "web")),
)
GOALS = (
    ("Security", ("secure", "security", "auth")),
    ("Performance", ("performance", "fast", "cache")),
    ("Refactoring", ("refactor", "clean", "improve")),
    ("Migration", ("migrate", "upgrade")),
    ("Testing", ("test", "testing")),
)
TECHNOLOGIES = (
    ("Flutter", ("flutter",)),
    ("Dart", ("dart",)),
    ("CSharp", ("c#", "csharp")),
    ("Python", ("python",)),
    ("Blazor", ("blazor",)),
    ("React", ("react",)),
    ("AI", ("ai", "llm", "chat")),
    ("Microsoft.Extensions.AI", ("microsoft.extensions.ai",)),
)
TRADES = (
    ("ecommerce", ("ecommerce", "e-commerce", "shop")),
    ("healthcare", ("healthcare", "health", "medical")),
    ("fintech", ("fintech", "finance", "bank")),
)
GOAL_CATEGORIES = {"Performance": ("Performance",), "Security": ("Security", "Validation")}
TYPE_CATEGORIES = {
    "MobileApp": ("ComponentModel", "StateManagement"),
    "AIAgent": ("AIAgents", "ToolIntegration"),
    "WebAPI": ("ResiliencyPatterns", "Security"),
}
DATABASE_CALLS = (
    "ExecuteAsync", "QueryAsync", "FirstOrDefaultAsync", "ToListAsync", "SaveChangesAsync", "AddAsync", "UpdateAsync",
    "RemoveAsync", "ExecuteReader", "ExecuteNonQuery", "ExecuteScalar",
)
HTTP_CALLS = ("HttpClient", "SendAsync", "GetAsync", "PostAsync", "PutAsync", "DeleteAsync", "RestClient")
LOGGING = ("Log",)  # the other names of its kind contain it
ASSERTIONS = ("assert ", "self.assert", "pytest.assert", ".should", ".expect")
TEST_MARKS = ("@pytest", "@unittest", "@test")


# --- queries and requests ---------------------------------------------------------------------------------


def strategy(query: Column) -> Column:
    """Which search a query asks for: patterns first, then relations by how many of their words it holds, words that
    contain each other counted each."""
    n = count_contained(query, RELATION_WORDS)
    named = query.rlike(r"\b[A-Z][a-zA-Z0-9]+(?:\.[A-Z][a-zA-Z0-9]+)*\b")
    return (
        F.when(contains_any(query, PATTERN_WORDS), "pattern-search")
        .when((n >= 2) | ((n >= 1) & named), "graph-first")
        .when(n == 1, "hybrid")
        .otherwise("semantic-first")
    )


def first_of(text: Column, kinds: Iterable[tuple[str, Iterable[str]]], default: str | None) -> Column:
    """The first kind any of whose words the text holds."""
    out = F.when(F.lit(False), F.lit(default))
    for name, words in kinds:
        out = out.when(contains_any(text, words), F.lit(name))
    return out.otherwise(F.lit(default))


def all_of(text: Column, kinds: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """The kinds any of whose words the text holds, in their order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in kinds]))


def _listed(value: Column, lists: dict[str, Iterable[str]]) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, entries in lists.items():
        out = out.when(value == name, F.array(*map(F.lit, entries)))
    return out.otherwise(F.array().cast("array<string>"))


def intent(request: Column) -> Column:
    """(project_type, goal, technologies, domain, categories) of a request, by keywords."""
    kind, goal = first_of(request, PROJECT_TYPES, None), first_of(request, GOALS, "NewFeature")
    categories = F.array_distinct(F.concat(_listed(goal, GOAL_CATEGORIES), _listed(kind, TYPE_CATEGORIES)))
    return F.struct(
        kind.alias("project_type"),
        goal.alias("goal"),
        all_of(request, TECHNOLOGIES).alias("technologies"),
        first_of(request, TRADES, None).alias("domain"),
        categories.alias("categories"),
    )


def related_languages(language: Column) -> Column:
    return _listed(F.lower(language), RELATED)


# --- lines of code ----------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _count(text: Column, test) -> Column:
    return F.size(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), test))


def cyclomatic(text: Column) -> Column:
    """One more than the decisions that lines begin with or hold, a line's inner ``and`` and ``or`` as one."""
    starts = lambda word: _count(text, lambda x: x.startswith(word + " "))
    inner = _count(text, lambda x: x.startswith("if ") | x.contains(" if "))
    joined = _count(text, lambda x: x.contains(" and ") | x.contains(" or "))
    return 1 + inner + joined + sum((starts(w) for w in ("elif", "while", "for", "except")), F.lit(0))


def cognitive(text: Column) -> Column:
    """Branches weighed by how deep they stand: one more than the nesting, which a deeper line raises and a shallower
    one lowers by one. One fold over the lines of a row."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("nested"), F.lit(0).alias("indent"))
    branch = r"^[ \t]*(if|elif|while|for) "

    def step(state: Column, line: Column) -> Column:
        indent = F.length(F.regexp_extract(line, r"^([ \t]*)", 1))
        nested = (
            F.when(indent > state["indent"], state["nested"] + 1)
            .when(indent < state["indent"], F.greatest(F.lit(0), state["nested"] - 1))
            .otherwise(state["nested"])
        )
        total = state["total"] + F.when(line.rlike(branch), 1 + nested).otherwise(0)
        return F.struct(total.alias("total"), nested.alias("nested"), indent.alias("indent"))

    written = F.filter(_lines(text), lambda x: F.trim(x) != "")
    return F.aggregate(written, start, step, lambda s: s["total"])


def is_async(text: Column) -> Column:
    return text.contains("async def") | text.contains("await ")


def handles_errors(text: Column) -> Column:
    return _count(text, lambda x: x.startswith("try:") | x.startswith("except")) > 0


def smells(loc: Column, params: Column, complexity: Column, nesting: Column, unhandled: Column) -> Column:
    """The names of what a method's figures tell against it."""
    return F.array_compact(
        F.array(
            F.when(loc > 50, "long_method"),
            F.when(params > 5, "too_many_parameters"),
            F.when(complexity > 10, "high_complexity"),
            F.when(nesting > 3, "deep_nesting"),
            F.when(unhandled, "async_without_error_handling"),
        )
    )


def method_score(
    cyclomatic_: Column, cognitive_: Column, loc: Column, nesting: Column, params: Column, calls: Column,
    unhandled: Column, logs: Column, asynchronous: Column, throws: Column,
) -> Column:
    """A hundred points less what figures and smells cost, with five for either good practice."""
    cost = lambda value, *steps: reduce(
        lambda w, s: w.when(value > s[0], s[1]), steps, F.when(F.lit(False), 0)
    ).otherwise(0)
    return (
        100
        - cost(cyclomatic_, (15, 30), (10, 20), (7, 10))
        - cost(cognitive_, (15, 25), (10, 15))
        - cost(loc, (100, 25), (50, 15))
        - cost(nesting, (4, 20), (3, 10))
        - cost(params, (5, 15))
        - F.when(unhandled, 20).otherwise(0)
        - cost(calls, (5, 10))
        + F.when(logs & (loc > 20), 5).otherwise(0)
        + F.when(asynchronous & throws, 5).otherwise(0)
    )


# Layers by a class's name and by its namespace, the first that fits; names that are layers and no context.
CLASS_LAYERS = (
    (r"Controller$", "API"), (r"(Service|Handler)$", "Domain"), (r"Repository$|DbContext", "Data"), (r"Validator$", "Domain"),
    (r"(Filter|Middleware)$", "Infra"), (r"(ViewModel|Component)$", "UI"), (r"Test", "Test"),
)
NAMESPACE_LAYERS = (
    (r"\.Controllers", "API"), (r"\.(Services|Domain)", "Domain"), (r"\.(Repositories|Data)", "Data"), (r"\.Infrastructure", "Infra"),
    (r"\.(UI|Views)", "UI"), (r"\.Tests", "Test"),
)
LAYER_NAMES = ("Controllers", "Services", "Domain", "Data", "Infrastructure", "UI", "Views", "Models", "Repositories")


def layer(name: Column, namespace: Column) -> Column:
    """The layer that a class belongs to: told by its name, else by its namespace, else ``Domain``."""
    told = [F.when(name.rlike(p), v) for p, v in CLASS_LAYERS] + [F.when(namespace.rlike(p), v) for p, v in NAMESPACE_LAYERS]
    return F.coalesce(*told, F.lit("Domain"))


def bounded_context(namespace: Column) -> Column:
    """The second part of a namespace if it isn't a layer's name, else the first; ``Default`` for null."""
    parts = F.split(namespace, r"\.")
    second = F.try_element_at(parts, F.lit(2))
    return F.coalesce(F.when(~second.isin(*LAYER_NAMES), second), F.try_element_at(parts, F.lit(1)), F.lit("Default"))


# Technologies that a task may name, in the order in which they are listed.
TASK_TECHNOLOGIES = (
    "flutter", "blazor", "react", "maui", "wpf", "winforms", "csharp", "c#", "python", "typescript", "javascript", "kotlin", "swift", "dart",
    "api", "rest", "grpc", "graphql", "websocket", "game", "blackjack", "todo", "chat", "calculator", "crud",
)


def task_keywords(task: Column) -> Column:
    """The technologies that a task names, as parts of words too; none for null."""
    known = F.array(*map(F.lit, TASK_TECHNOLOGIES))
    return let(F.lower(F.coalesce(task, F.lit(""))), lambda t: F.filter(known, lambda k: F.contains(t, k)))


# Words that leave something open in a task, words that settle it, and what is open then: term, category, impact.
AMBIGUITIES = (
    (("auth", "login", "authentication", "sign in"), (), "authentication", "Authentication", "High"),
    (("auth", "login", "authentication", "sign in"), (), "token storage", "Authentication", "Medium"),
    (("database", "db", "data", "storage", "persistence"), (), "database", "Database", "High"),
    (("database", "db", "data", "storage", "persistence"), (), "data access", "Database", "Medium"),
    (("cache", "caching"), (), "cache provider", "Caching", "Medium"),
    (("cache", "caching"), (), "cache expiration", "Caching", "Low"),
    (("ui", "interface", "web", "frontend", "page", "component"), ("blazor", "react", "vue", "angular", "mvc"), "ui framework", "UI", "High"),
    (("ui", "interface", "web", "frontend", "page", "component"), (), "css framework", "UI", "Low"),
    (("api", "rest", "endpoint", "service"), (), "api style", "API", "Medium"),
    (("api", "rest", "endpoint", "service"), (), "api documentation", "API", "Low"),
)
ALWAYS_OPEN = ("error handling", "Architecture", "Medium")


def ambiguities(task: Column) -> Column:
    """(term, category, impact) of all that a task leaves open, in order, and how errors are handled if anything is; none
    for null."""
    holds = lambda t, words: functools.reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words], F.lit(False))

    def opened(t: Column) -> Column:
        row = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("term", "category", "impact"))])
        found = F.array_compact(F.array(*[F.when(holds(t, words) & ~holds(t, settled), row(*v)) for words, settled, *v in AMBIGUITIES]))
        return let(found, lambda x: F.when(F.size(x) > 0, F.array_append(x, row(*ALWAYS_OPEN))).otherwise(x))

    return let(F.lower(F.coalesce(task, F.lit(""))), opened)


# What a grade counts in the mean of a file.
GRADE_POINTS = {"A": 95, "B": 85, "C": 75, "D": 65, "F": 50}


def overall_grade(grade: Column) -> Column:
    """The grade of a group: that of its members' mean points; an unknown grade counts as the lowest."""
    points = F.avg(F.coalesce(*[F.when(grade == g, F.lit(p)) for g, p in GRADE_POINTS.items()], F.lit(50)))
    return F.when(points >= 90, "A").when(points >= 80, "B").when(points >= 70, "C").when(points >= 60, "D").otherwise("F")


def database_calls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\b\w*(?:" + "|".join(DATABASE_CALLS) + r")\w*\("))


def holds_any(text: Column, names: Iterable[str]) -> Column:
    """Whether a name stands in the text, in its own case."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in names], F.lit(False))


def thrown(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bthrow\s+new\s+([\w.]+)"), F.lit(1)))


def is_test(name: Column, decorators: Column) -> Column:
    marked = F.exists(decorators, lambda d: contains_any(d, TEST_MARKS))
    return name.startswith("test_") | F.coalesce(marked, F.lit(False))


def test_framework(decorators: Column, imports: Column) -> Column:
    of = lambda name: F.exists(decorators, lambda d: d.contains("@" + name)) | F.exists(imports, lambda i: i.contains(name))
    return F.when(of("pytest"), "pytest").when(of("unittest"), "unittest").otherwise("unknown")


def assertions(text: Column) -> Column:
    """Lines that assert something."""
    return F.size(F.filter(_lines(text), lambda x: contains_any(x, ASSERTIONS)))


def classified_imports(modules: Column, standard: Iterable[str], third_party: Iterable[str], project: Iterable[str]) -> Column:
    """(module, kind) of each: local by a leading dot or slash, then by the first part of its name."""
    def among(root: Column, names: Iterable[str]) -> Column:
        return root.isin(*names)

    def told(m: Column) -> Column:
        root = F.regexp_extract(m, r"^(@?[\w-]+)", 1)
        kind = (
            F.when(m.rlike(r"^[./]"), "local")
            .when(among(root, standard), "standard")
            .when(among(root, project), "project")
            .when(among(root, third_party), "third-party")
            .otherwise("unknown")
        )
        return F.struct(m.alias("module"), kind.alias("kind"))

    return F.transform(modules, told)


# --- style sheets -----------------------------------------------------------------------------------------


def style_issues(text: Column) -> Column:
    """(inline_styles, no_variables, float_layout, no_responsive, no_focus, prefixes) of a page's source."""
    has = lambda *words: holds_any(text, words)
    modern = has("display: grid", "display:grid", "display: flex", "display:flex")
    return F.struct(
        F.regexp_count(text, F.lit('style="[^"]+"')).alias("inline_styles"),
        (~has("var(--", ":root")).alias("no_variables"),
        (has("float:") & ~modern).alias("float_layout"),
        (~has("@media")).alias("no_responsive"),
        (~has(":focus")).alias("no_focus"),
        has("-webkit-", "-moz-").alias("prefixes"),
    )


def style_score(issues: Column) -> Column:
    """From 0 to 100: a hundred less 1.5 an inline style and 5 an issue; variables and media queries give 10 each."""
    flags = [issues[c].cast("int") for c in ("no_variables", "float_layout", "no_responsive", "no_focus", "prefixes")]
    found = sum(flags, (issues["inline_styles"] > 0).cast("int"))
    bonus = sum((F.when(issues[c], 0).otherwise(10) for c in ("no_variables", "no_responsive")), F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 1.5 * issues["inline_styles"] - 5 * found + bonus))


def inline_styles(text: Column) -> Column:
    """(element, styles) of each element with a style attribute, in order; styles as a map, of equal names the last."""
    whole = r'<(\w+)[^>]*style="([^"]+)"[^>]*>'
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(whole), F.lit(k)).alias(n) for k, n in ((1, "element"), (2, "style"))])

    def parsed(style: Column) -> Column:
        pairs = F.filter(F.split(style, ";"), lambda p: p.contains(":"))
        named = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
        last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(last)

    return F.transform(found, lambda f: F.struct(f["element"].alias("element"), parsed(f["style"]).alias("styles")))


def accessibility(html: Column) -> Column:
    """What a page has that keeps people out, counted."""
    count = lambda p: F.regexp_count(html, F.lit(p))
    icons = F.regexp_extract_all(html, F.lit(r"(?i)<button[^>]*>\s*<(?:svg|i)\b"), F.lit(0))
    return F.struct(
        (count(r"(?i)<img\b") - count(r"(?i)<img\b[^>]*alt=")).alias("no_alt"),
        count(r'(?i)<(button|a|input)[^>]*aria-hidden="true"').alias("hidden"),
        count(r'(?i)tabindex="([2-9]|\d{2,})"').alias("tabs"),
        count(r"(?i)<div[^>]*onclick").alias("clickable"),
        (~F.lower(html).contains("<main") & (F.length(html) > 500)).alias("no_main"),
        (~html.rlike(r"<html[^>]*\blang=")).alias("no_lang"),
        F.size(F.filter(icons, lambda x: ~x.contains("aria-label"))).alias("icons"),
    )
