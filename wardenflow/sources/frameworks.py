"""Frameworks that a tree's manifests name (S27): dependency keys of package.json, and patterns over the texts of other manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dependencies and the frameworks they stand for.
JS_FRAMEWORKS = {
    "express": "express", "koa": "koa", "fastify": "fastify", "@nestjs/core": "nestjs", "next": "next.js", "nuxt": "nuxt", "@hapi/hapi": "hapi", "hapi": "hapi", "sails": "sails", "restify": "restify", "react": "react", "vue": "vue",
    "@angular/core": "angular", "svelte": "svelte", "apollo-server": "apollo", "graphql": "graphql", "socket.io": "socket.io", "mongoose": "mongoose", "sequelize": "sequelize", "prisma": "prisma", "knex": "knex", "typeorm": "typeorm", "passport": "passport", "jsonwebtoken": "jwt",
}
# Patterns over manifests by file name.
PY_RULES = tuple((rf"(?i)\b{name}\b", name) for name in "flask django fastapi tornado bottle pyramid sanic aiohttp sqlalchemy".split())
TEXT_MANIFESTS = {
    "requirements.txt": PY_RULES,
    "pyproject.toml": PY_RULES,
    "Pipfile": PY_RULES,
    "setup.py": PY_RULES,
    "Cargo.toml": tuple((rf"(?m)^\s*{name}\s*=", name) for name in "actix-web axum rocket warp tide diesel sqlx".split()),
    "build.gradle.kts": ((r"org\.springframework", "spring"),),
    "mix.exs": ((r":phoenix\b", "phoenix"), (r":plug\b", "plug"), (r":ecto\b", "ecto")),
    "deno.json": ((r"\boak\b", "oak"), (r"\bfresh\b", "fresh")),
    "go.mod": ((r"gin-gonic/gin", "gin"), (r"labstack/echo", "echo"), (r"gofiber/fiber", "fiber"), (r"go-chi/chi", "chi"), (r"gorilla/mux", "gorilla/mux"), (r"gorm\.io/gorm", "gorm")),
    "Gemfile": tuple((rf"(?i)\b{name}\b", name) for name in "rails sinatra sequel hanami".split()),
    "composer.json": ((r"laravel/framework", "laravel"), (r"symfony/", "symfony"), (r"slim/slim", "slim")),
    "build.gradle": ((r"(?i)springframework|org\.springframework|spring-boot", "spring"),),
    "pom.xml": ((r"(?i)springframework", "spring"), (r"(?i)jersey", "jersey")),
}
DEEPEST = 3


def frameworks(files: DataFrame, depth: int = DEEPEST) -> DataFrame:  # S27
    """file, framework of each manifest among ``files`` (file, content) in folders up to ``depth`` deep; what cannot be parsed names none."""
    name = F.substring_index("file", "/", -1)
    level = F.size(F.split("file", "/")) - 1
    manifests = files.filter(name.isin("package.json", *TEXT_MANIFESTS) & (level <= depth))
    keys = "map<string, string>"
    parsed = manifests.filter(name == "package.json").select("file", F.from_json("content", f"dependencies {keys}, devDependencies {keys}, peerDependencies {keys}").alias("j"))
    none = F.array().cast("array<string>")
    named = F.concat(*[F.coalesce(F.map_keys(f"j.{c}"), none) for c in ("dependencies", "devDependencies", "peerDependencies")])
    book = F.create_map(*[F.lit(x) for item in JS_FRAMEWORKS.items() for x in item])
    by_key = parsed.select("file", F.explode(named).alias("key")).select("file", F.try_element_at(book, F.col("key")).alias("framework")).filter("framework is not null")
    cells = [F.when((name == file) & F.col("content").rlike(pattern), F.lit(label)) for file, rules in TEXT_MANIFESTS.items() for pattern, label in rules]
    by_text = manifests.filter(name != "package.json").select("file", F.explode(F.array_compact(F.array(*cells))).alias("framework"))
    return by_key.unionByName(by_text).distinct()


def detected(files: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """Each framework once, in order."""
    return frameworks(files, depth).select("framework").distinct().orderBy("framework")
