"""Names that frameworks give meaning to: candidates for references by kind and place, one join for all rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.paths import dirname

PASCAL = "^[A-Z][a-zA-Z]+$"


@dataclass(frozen=True)
class Rule:
    """A reference whose name matches means a symbol of these kinds, in these directories if it can be."""

    framework: str
    name: str
    kinds: tuple[str, ...]
    folders: tuple[str, ...]
    confidence: float


#: Of each framework: its languages and what its sources hold.
FRAMEWORKS = {
    "django": (("python",), r"\bdjango\b"), "flask": (("python",), r"Flask\(__name__\)"), "fastapi": (("python",), r"FastAPI\("),
    "rails": (("ruby",), r"Rails\.application|ApplicationController|ActiveRecord"), "spring": (("java", "kotlin"), r"@(SpringBootApplication|RestController|Service|Repository)\b"),
    "aspnet": (("csharp",), r"Microsoft\.AspNetCore|WebApplication|\[ApiController\]"), "go": (("go",), r"\bpackage\s+\w+"), "rust": (("rust",), r"\bfn\s+\w+"),
    "swiftui": (("swift",), r"import SwiftUI"), "uikit": (("swift",), r"import UIKit"), "vapor": (("swift",), r"import Vapor"),
    "laravel": (("php",), r"Illuminate\\|Route::"), "express": (("typescript", "javascript"), r"express\(\)|require\(['\"]express"),
    "nestjs": (("typescript",), r"@nestjs/|@Controller\("), "react": (("tsx", "jsx", "typescript", "javascript"), r"from ['\"]react['\"]"),
    "svelte": (("svelte", "typescript", "javascript"), r"\$app/|from ['\"]svelte"), "vue": (("vue", "typescript", "javascript"), r"from ['\"]vue['\"]|defineComponent"),
}
# Conventional names, kinds, directories and confidences.
RULES = (
    Rule("django", "Model$|^[A-Z][a-z]+$", ("class",), ("models",), 0.8), Rule("django", "(View|ViewSet)$", ("class", "function"), ("views",), 0.8), Rule("django", "Form$", ("class",), ("forms",), 0.8),
    Rule("flask", "(_bp|_blueprint)$", ("variable",), (), 0.8), Rule("fastapi", "_router$|^router$", ("variable",), ("routers", "api", "routes", "endpoints"), 0.8), Rule("fastapi", "^(get_|Depends)", ("function",), ("dependencies", "deps", "core"), 0.75),
    Rule("rails", PASCAL, ("class",), ("models",), 0.8), Rule("rails", "Controller$", ("class",), ("controllers",), 0.85), Rule("rails", "Helper$", ("module",), ("helpers",), 0.8), Rule("rails", "(Service|Job)$", ("class",), ("services", "jobs"), 0.8),
    Rule("spring", "Service$", ("class", "interface"), ("service", "services"), 0.85), Rule("spring", "Repository$", ("class", "interface"), ("repository", "repositories"), 0.85), Rule("spring", "Controller$", ("class",), ("controller", "controllers"), 0.85),
    Rule("spring", PASCAL, ("class",), ("entity", "entities", "model", "models", "domain"), 0.7), Rule("spring", "(Component|Config)$", ("class",), ("component", "components", "config"), 0.8),
    Rule("aspnet", "Controller$", ("class",), ("Controllers",), 0.85), Rule("aspnet", "Service$|^I.", ("class", "interface"), ("Services", "Service", "Application"), 0.85), Rule("aspnet", "Repository$", ("class", "interface"), ("Repositories", "Repository", "Data", "Infrastructure"), 0.85),
    Rule("aspnet", PASCAL, ("class",), ("Models", "Model", "Entities", "Entity", "Domain"), 0.7), Rule("aspnet", "(ViewModel|Dto)$", ("class",), ("ViewModels", "ViewModel", "DTOs", "Dto"), 0.8),
    Rule("go", "Handler$|^Handle", ("function",), ("handler", "handlers", "api", "routes", "controller", "controllers"), 0.8), Rule("go", "(Service|Repository|Store)$", ("struct", "interface"), ("service", "services", "repository", "store", "pkg"), 0.8),
    Rule("go", "Middleware$|^(Auth|Log)", ("function",), ("middleware", "middlewares"), 0.75), Rule("go", PASCAL, ("struct",), ("model", "models", "entity", "entities", "domain", "pkg"), 0.7),
    Rule("rust", "_handler$|^handle_", ("function",), ("handlers", "handler", "api", "routes", "controllers"), 0.8), Rule("rust", "(Service|Repository)$", ("struct", "trait"), ("services", "service", "repository", "domain"), 0.8), Rule("rust", PASCAL, ("struct",), ("models", "model", "entities", "entity", "domain", "types"), 0.7),
    Rule("swiftui", "^[A-Z].*View$", ("struct", "component"), ("Views", "View", "Screens", "Components"), 0.85), Rule("swiftui", "(ViewModel|Store|Manager)$", ("class",), ("ViewModels", "Stores", "Managers"), 0.85),
    Rule("uikit", "ViewController$", ("class",), ("ViewControllers", "Controllers", "Screens"), 0.85), Rule("vapor", "Controller$", ("class", "struct"), ("Controllers",), 0.85),
    Rule("laravel", "Controller$", ("class",), ("Controllers",), 0.85), Rule("laravel", PASCAL, ("class",), ("Models",), 0.7), Rule("express", "Middleware$", ("function",), ("middleware", "middlewares"), 0.8), Rule("express", "(Controller|Service)$", ("class", "function", "variable"), ("controllers", "services"), 0.8),
    Rule("nestjs", "(Service|Controller|Module|Guard|Pipe|Interceptor)$", ("class",), (), 0.85), Rule("react", PASCAL, ("component", "function", "class"), ("components", "pages", "views"), 0.8), Rule("react", "^use[A-Z]", ("function",), ("hooks",), 0.85),
    Rule("svelte", PASCAL, ("component",), ("components", "lib"), 0.8), Rule("vue", PASCAL, ("component",), ("components", "views", "pages"), 0.8), Rule("vue", "^use[A-Z]", ("function",), ("composables",), 0.85),
)


def detected(sources: DataFrame) -> list[str]:
    """Frameworks whose marks stand in any source (path, content); one pass."""
    row = sources.agg(*[F.bool_or(F.col("content").rlike(mark)).alias(name) for name, (_, mark) in FRAMEWORKS.items()]).first()
    return [name for name in FRAMEWORKS if row[name]]


def by_convention(refs: DataFrame, nodes: DataFrame, frameworks: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): the first rule that finds a symbol; of several the one in the rule's directories, then the smallest id."""
    active = [r for r in rules if r.framework in frameworks]
    shape = "ref_id bigint, target string, confidence double, resolved_by string"
    if not active:
        return refs.sparkSession.createDataFrame([], shape)
    met = F.filter(F.array(*[F.when(F.col("language").isin(*FRAMEWORKS[r.framework][0]) & F.col("reference_name").rlike(r.name), F.lit(k)) for k, r in enumerate(active)]), lambda k: k.isNotNull())
    asked = refs.select("ref_id", F.col("reference_name").alias("name"), F.explode(met).alias("rule"))
    # Bearers of a name are first reduced to one a kind and directory.
    bearers = nodes.groupBy("name", "kind", dirname(F.col("file_path")).alias("folder")).agg(F.min("id").alias("target"))
    kinds = F.array(*[F.array(*map(F.lit, r.kinds)) for r in active])
    places = F.array(*[F.array(*map(F.lit, r.folders)) if r.folders else F.array().cast("array<string>") for r in active])
    sure = F.array(*[F.lit(r.confidence) for r in active])
    both = asked.join(bearers, "name").filter(F.array_contains(F.get(kinds, F.col("rule")), F.col("kind")))
    outside = ~F.arrays_overlap(F.split("folder", "/"), F.get(places, F.col("rule")))
    best = F.row_number().over(Window.partitionBy("ref_id").orderBy("rule", outside, "target"))
    chosen = both.withColumn("place", best).filter("place = 1")
    return chosen.select("ref_id", "target", F.get(sure, F.col("rule")).alias("confidence"), F.lit("framework").alias("resolved_by"))
