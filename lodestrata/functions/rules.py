"""Rule tables as Column expressions: what a question wants, which kinds of facts it names, what a path or a package is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.arrays import bound
from lodestrata.functions.text import ascii_words, fold, found_in

# Intents of questions with their rules (weight, pattern), on folded text, Turkish and English.
INTENT_RULES: dict[str, list[tuple[int, str]]] = {
    "impact": [
        (7, r"\b(?:degisir(?:se)?|degistirirsem|degisiklig\w*|etkilen\w*|etkile(?:r|yebilir)|impact|affected|blast radius)\b"),
        (6, r"\b(?:hangi\s+(?:route|component|bilesen|handler|akis)(?:lar)?\s+riskli|etki\s+kapsami|route\s+kapsami)\b"),
    ],
    "explain-flow": [
        (7, r"\b(?:hangi sirayla|adim adim|step by step|end[- ]to[- ]end)\b"),
        (6, r"\b(?:ui(?:'|’)dan|client(?:'|’)dan|formdan|browserdan).{0,40}\b(?:backend|server|upstream)\b"),
        (6, r"\b(?:akis\w*|flow|zincir\w*|pipeline)\b"),
        (6, r"\b(?:nasil|hangi yoldan).{0,70}\b(?:gider|gecer|ilerler)\b"),
        (5, r"\b(?:nasil).{0,50}\b(?:donus\w*|uretilir|ulasir|baglanir)\b"),
        (5, r"\b(?:iceri[kg]\w*|veri\w*|gorsel\w*).{0,45}\b(?:nereden|nasil).{0,25}\bgelir\b"),
    ],
    "implementation-plan": [
        (9, r"\b(?:yeni|new)\b.{0,70}\b(?:ekle\w*|implement\w*|create|build)\b"),
        (7, r"\b(?:nereler|hangi dosyalar|what files)\b.{0,30}\b(?:degismeli|degisecek|change)\b"),
        (6, r"\b(?:hangi mevcut pattern|hangi pattern|implementation plan|uygulama plani|nasil implemente)\b"),
        (7, r"\b(?:yeni|new)\b.{0,70}\b(?:dogru yol|how should|kullanimi)\b"),
    ],
    "debug": [
        (7, r"\b(?:neden|why)\b.{0,70}\b(?:failed|fail|error|hata|bozuk|unreachable|unavailable|configured|dondu|dondurur|dondurebilir|yanlis)\b"),
        (7, r"\b(?:4\d\d|5\d\d|exception|stack trace|captcha failed|upstream unreachable|not configured)\b"),
        (6, r"\b(?:debug|troubleshoot|kok neden|root cause|kontrol edilmeli|check first)\b"),
        (8, r"\b(?:bozuk\w*|broken|calismiyor|eksik|missing|unavailable)\b"),
    ],
    "verify": [
        (8, r"\b(?:hangi komutlar|what commands|verification commands?|dogrulama adimlari|nasil dogrular)\b"),
        (8, r"\b(?:automated[- ]test|test stratejisi|test strategy|dogrulama stratejisi|test boslugu|coverage gap|coverage boslugu|hangi testler)\b"),
        (6, r"\b(?:lint|typecheck|type-check|test suite|ci checks?|quality gate)\b"),
    ],
    "change-review": [
        (8, r"\b(?:diff|change review|degisiklik incele|review (?:this |the )?(?:change|pr)|before.{0,20}after)\b"),
        (8, r"\b(?:sonrasinda|since)\b.{0,60}\b(?:ne degisti|neler degisti|changed|davranis\w*)\b"),
        (6, r"\b(?:working tree|indexed sha|target head|hedef head|commit sha|hangi sha|memory guncel|freshness|stale)\b"),
    ],
    "lookup": [
        (5, r"\b(?:listele|list all|inventory|hangi route\w*|which routes|hangi handler\w*|which handlers)\b"),
        (4, r"\b(?:nerede|where|hangi dosya\w*|which file|hangi endpoint\w*|which endpoint|hangi surum\w*|what version|nedir|what is)\b"),
        (4, r"\b(?:hangi kaynaklardan|which sources|nereden tanimlanir)\b"),
        (4, r"\b(?:gercekte ne yapiyor|what does .{0,30} do|kabul ediyor|kullaniliyor mu|does .{0,30} use)\b"),
    ],
}
LEAST_SCORE = 4

# Kinds of facts and the words of a question that name them.
TYPE_TERMS: dict[str, str] = {
    "middleware": r"\b(middleware|proxy|matcher)\b",
    "authentication": r"\b(auth|authentication|login|session|cookie|token)\b",
    "authorization": r"\b(authoriz(?:e|ation)|permission|role|forbidden|unauthorized|yetki|izin|rol)\b",
    "cache": r"\b(cache|revalidate|ttl|no-store|force-cache)\b",
    "cache_invalidation": r"\b(invalidate|invalidation|revalidateTag|updateTag|revalidatePath|cache tag)\b",
    "server_function": r"\b(server action|server function|use server)\b",
    "rendering": r"\b(render|rendering|ssr|ssg|isr|rsc|csr|dynamic|static)\b",
    "api_dependency": r"\b(api|backend|endpoint|fetch|axios|graphql)\b",
    "configuration": r"\b(config|configuration|environment|env)\b",
    "dependency": r"\b(dependency|package|npm)\b",
    "seo": r"\b(seo|metadata|canonical|robots|sitemap)\b",
    "special_file": r"\b(loading|template|not-found|global-error|forbidden|unauthorized|robots|sitemap|manifest|opengraph-image|twitter-image)\b",
    "next_config": r"\b(next\.config|rewrite|redirects?|headers|basePath|assetPrefix|transpilePackages)\b",
    "schema_contract": r"\b(schema|validation|zod|yup|valibot|formdata|payload|form field)\b",
    "analytics_event": r"\b(?:analytics\s+event\w*|tracking\s+event\w*|gtag|dataLayer|trackEvent|event\s+payload)\b",
    "security": r"\b(security|csp|nonce|authorization)\b",
    "error_handling": r"\b(error|failed|failure|hata|4\d\d|5\d\d)\b",
    "module_contract": r"\b(contract|registry|adapter|provider|pattern)\b",
}
#: With events named, only these words still mean a schema.
SCHEMA_WORDS = r"\b(schema|validation|zod|yup|valibot|formdata|form payload|json payload)\b"

# Which analyses a changed path concerns; of the first list only the first match counts, the second adds to sources.
PATH_KINDS: list[tuple[str, str]] = [
    (r"(^|/)package\.json$|(?:pnpm-lock\.yaml|yarn\.lock|package-lock\.json)$", "repository build"),
    (r"(^|/)next\.config\.(?:js|mjs|cjs|ts)$", "repository route configuration build security"),
    (r"(^|/)(?:middleware|proxy)\.(?:ts|js)$", "middleware authentication route security"),
    (r"(^|/)(?:Dockerfile|docker-compose[^/]*|tsconfig\.json)$", "build configuration"),
    (r"(^|/)\.env(?:\.[^/]+)?$", "configuration security"),
    (r"^(?:src/)?app/(?:.*/)?(?:robots\.txt|sitemap\.xml|manifest\.webmanifest)$", "seo configuration"),
    (r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "rendering api cache authentication state seo analytics configuration security performance technical-debt"),
]
SOURCE_KINDS: list[tuple[str, str]] = [
    (r"(^|/)(?:app|pages)/", "route"),
    (r"(^|/)(?:services?|api|clients?|queries)/", "api"),
    (r"(^|/)providers?/", "state authentication"),
]

# What a package is for, by its name; the first match counts.
PACKAGE_CATEGORIES: list[tuple[str, str]] = [
    (r"^(next|react|react-dom)$", "framework/runtime"),
    (r"(@tanstack/react-query|react-query|swr|axios|ky|graphql|@apollo/client)", "data-fetching"),
    (r"(redux|zustand|jotai|mobx|recoil)", "state-management"),
    (r"(tailwind|styled-components|@emotion|sass|vanilla-extract)", "styling"),
    (r"(next-auth|@auth/|jsonwebtoken|jose)", "authentication"),
    (r"(jest|vitest|playwright|cypress|testing-library|storybook)", "testing"),
    (r"(?i)(google-analytics|gtag|gtm|segment|adobe|analytics)", "analytics"),
]

# Which store owns a class of memories.
OWNERS = {
    "personal-preference": "agent-native",
    "episodic-task-state": "agent-native",
    "workflow-policy": "repository-instructions",
    "repository-fact": "context-engine",
    "semantic-relation": "context-engine",
    "human-decision": "context-engine",
}


def intent(question: Column) -> Column:
    """struct(intent, confidence, score, margin): the intent whose rules weigh most; unknown below LEAST_SCORE and for ties."""
    said = fold(question)
    totals = [F.struct(sum((F.when(said.rlike(ascii_words(p)), w).otherwise(0) for w, p in rules), F.lit(0)).alias("score"), F.lit(name).alias("intent")) for name, rules in INTENT_RULES.items()]
    ranked = F.sort_array(F.array(*totals), asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    score, margin = F.coalesce(first["score"], F.lit(0)), F.coalesce(first["score"] - second["score"], F.lit(0))
    known = (score >= LEAST_SCORE) & (margin > 0)
    sure = F.when((score >= 7) & (margin >= 3), "high").when(margin >= 2, "medium").otherwise("low")
    return F.struct(
        F.when(known, first["intent"]).otherwise("unknown").alias("intent"),
        F.when(known, sure).otherwise("low").alias("confidence"),
        score.alias("score"),
        margin.alias("margin"),
    )


def memory_types(question: Column) -> Column:
    """The kinds of facts that a question names, in the order of TYPE_TERMS."""
    kinds = lambda low: F.array_compact(F.array(*[F.when(found_in(question, p, low), F.lit(k)) for k, p in TYPE_TERMS.items()]))

    def settled(found: Column) -> Column:
        no_schema = F.array_contains(found, "analytics_event") & ~found_in(question, SCHEMA_WORDS)
        return F.when(no_schema, F.array_remove(found, "schema_contract")).otherwise(found)

    # The lower case and the kinds are computed once and not anew where they are used.
    return bound(bound(F.lower(question), kinds), settled)


def path_kinds(path: Column) -> Column:
    """The analyses that a change of this path concerns; none if it is of no interest."""
    file = F.replace(path, F.lit("\\"), F.lit("/"))
    of = lambda kinds: F.array(*map(F.lit, kinds.split()))
    none = F.array().cast("array<string>")
    first = F.coalesce(*[F.when(file.rlike(p), of(kinds)) for p, kinds in PATH_KINDS], none)
    more = [F.when(file.rlike(PATH_KINDS[-1][0]) & file.rlike(p), of(kinds)).otherwise(none) for p, kinds in SOURCE_KINDS]
    # A source is one only if no earlier pattern took it.
    earlier = F.coalesce(*[F.when(file.rlike(p), F.lit(True)) for p, _ in PATH_KINDS[:-1]], F.lit(False))
    return F.when(earlier, first).otherwise(F.array_distinct(F.concat(first, *more)))


def package_category(name: Column, internal_scope: str | None = None) -> Column:
    """What a package is for; packages of the internal scope (`@team/`) are internal; null if nothing says it."""
    rules = [F.when(name.rlike(p), c) for p, c in PACKAGE_CATEGORIES]
    own = [F.when(name.startswith(internal_scope), "internal-package")] if internal_scope else []
    return F.coalesce(*own, *rules)


def owner(memory_class: Column) -> Column:
    """The store that owns a class of memories; null for an unknown class."""
    return F.coalesce(*[F.when(memory_class == k, v) for k, v in OWNERS.items()])


def next_major(version: Column) -> Column:
    """The major number of a version as manifests write it (`^15.1.0`, `next@14.2`, `~13.4`); null if there is none."""
    named = F.regexp_extract(version, r"(?i)(?:^|\bnext[-@/])v?(\d{1,2})\.", 1)
    ranged = F.regexp_extract(version, r"^[~^<>=\s]*v?(\d{1,2})\.", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(ranged, F.lit(""))).cast("int")


def asked_major(question: Column) -> Column:
    """The major number of the framework that a question names (`Next 16`, `next.js version 15`); null if there is none."""
    return F.nullif(F.regexp_extract(question, r"(?i)Next(?:\.js)?\s*(?:version\s*)?(\d{1,2})", 1), F.lit("")).cast("int")


def decision_fault(key: Column, title: Column, rationale: Column, source_kind: Column, source_ref: Column, source_sha: Column, approved_by: Column, approved_at: Column) -> Column:
    """The first reason why a decision can't be stored; null if it can."""
    given = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return (
        F.when(~F.coalesce(key.rlike("^(?i)[a-z0-9][a-z0-9._-]{2,79}$"), F.lit(False)), "key")
        .when(F.length(given(title)) < 3, "title")
        .when(F.length(given(rationale)) < 10, "rationale")
        .when(given(source_ref) == "", "source-ref")
        .when((source_kind == "adr") & ~source_ref.rlike(r"(?i)\.md(?:#|$)"), "adr-not-markdown")
        .when(source_sha.isNotNull() & (source_sha != "") & ~source_sha.rlike("^(?i)[0-9a-f]{40}$"), "source-sha")
        .when(given(approved_by) == "", "approved-by")
        .when(F.try_to_timestamp(approved_at).isNull(), "approved-at")
    )


def miss_class(error: Column, gaps: Column, results: Column, fallback: Column) -> Column:
    """Why an answer fell short, as far as the engine can tell: gaps are one text; null if nothing says so."""
    said = F.lower(F.coalesce(gaps, F.lit("")))
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "engine-error")
        .when(F.contains(said, F.lit("seed could not be resolved")), "wrong-intent")
        .when(F.contains(said, F.lit("semantic graph unavailable")), "engine-error")
        .when(F.coalesce(results, F.lit(0)) == 0, "missing-fact")
        .when(fallback == "targeted-source", "missing-evidence")
    )


def question_shape(question: Column) -> Column:
    """struct(words, bucket, turkish, route, file, config): a question's shape without its words."""
    n = F.length(question)
    return F.struct(
        F.regexp_count(question, F.lit(r"\S+")).alias("words"),
        F.when(n < 40, "xs").when(n < 120, "s").when(n < 400, "m").otherwise("l").alias("bucket"),
        question.rlike("[çğıöşüÇĞİÖŞÜ]").alias("turkish"),
        question.rlike(r"(^|\s)/[\w\[\]/-]*").alias("route"),
        question.rlike(ascii_words(r"[\w/-]+\.(?:tsx?|jsx?|json|mjs|cjs)\b")).alias("file"),
        question.rlike(ascii_words(r"\b[A-Z][A-Z0-9_]{3,}\b")).alias("config"),
    )


# What questions about decisions, a repository's ways, links between repositories, and flows of data say. Of the first
# kind one of DECISION, or both of DECISION_TOGETHER; of the second both; of the others one.
DECISION = (
    r"\b(?:hangi karar|decision record|rationale|gerekçe|adr)\b",
    r"\bwhy\s+(?:did|do|does|was|were|is|are|has|have)\b[\s\S]{0,40}?(?:choose|chosen|choosing|use|using|adopt|adopted|pick|picked|prefer|switch)",
)
DECISION_TOGETHER = (r"\b(?:neden|niçin|nicin|niye)\b", r"(?:se[çc](?:ti|tik|tiler|ildi|ilmiş|ilmis|im|iyoruz)|tercih|karar\s*ver|ge[çc](?:tik|ildi|ti))")
STRATEGY_TOGETHER = (r"\b(project|proje(?:nin|de|yi)?|repository|repo)\b", r"\b(strategy|strateji(?:si)?|testing|test|error[- ]handling|hata yönetimi)\b")
LINKS = (
    r"\b(cross[- ]repo|inter[- ]repo|repository dependenc|repo dependenc|depends on (?:which )?repo|which repo(?:s)? (?:uses?|consumes?))\b",
    r"(?:repo|repository).{0,30}(?:bağımlı|bağımlılık|kullanıyor|tüketiyor)|(?:bağımlı|bağımlılık).{0,30}(?:repo|repository)",
)
FLOW = (
    r"\b(data|fetch|endpoint|service chain)\b",
    r"(?:ürün|sayfa).{0,30}(?:veri(?:si|sini)?|servis zinciri)|(?:veri|servis zinciri).{0,30}(?:nereden|akış|alır|getirir)",
)


def question_subjects(question: Column) -> Column:
    """struct(decision, strategy, links, flow): what a question is about; null text is about nothing."""
    says = lambda p: F.coalesce(question.rlike("(?i)" + ascii_words(p)), F.lit(False))
    return F.struct(
        (says(DECISION[0]) | says(DECISION[1]) | (says(DECISION_TOGETHER[0]) & says(DECISION_TOGETHER[1]))).alias("decision"),
        (says(STRATEGY_TOGETHER[0]) & says(STRATEGY_TOGETHER[1])).alias("strategy"),
        (says(LINKS[0]) | says(LINKS[1])).alias("links"),
        (says(FLOW[0]) | says(FLOW[1])).alias("flow"),
    )
