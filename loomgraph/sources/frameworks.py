"""Frameworks that a file uses, told by what it imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that tell a framework, for Python files and for scripts.
PYTHON = {
    "django": ("from django", "import django"),
    "fastapi": ("from fastapi", "import fastapi"),
    "flask": ("from flask", "import flask"),
    "django-rest-framework": ("from rest_framework",),
    "django-ninja": ("from ninja", "import ninja", "from ninja_extra", "import ninja_extra", "from ninja_jwt"),
    "pytest": ("import pytest", "from pytest"),
    "unittest": ("import unittest", "from unittest"),
}
SCRIPT = {
    "express": ("from 'express'", 'from "express"', "require('express')", 'require("express")'),
    "react": ("from 'react'", 'from "react"', "from 'react-dom'", 'from "react-dom"'),
    "nextjs": ("from 'next/", 'from "next/'),
    "nestjs": ("@nestjs",),
    "react-router": ("react-router",),
    "vue": ("from 'vue'", 'from "vue"'),
    "fastify": ("from 'fastify'", 'from "fastify"'),
    "axios": ("from 'axios'", 'from "axios"', "require('axios')", 'require("axios")'),
    "prisma": ("from '@prisma/client'", 'from "@prisma/client"'),
}
SCRIPT_TESTS = {name: (f"'{name}'", f'"{name}"') for name in ("vitest", "jest", "bun:test", "mocha", "jasmine")}
TEST_CALLS = ("describe(", "describe.each(", "it(", "it.each(", "test(", "test.each(")


def frameworks_of(path: str, text: str) -> list[str]:
    """Names in order; a script with test calls and no test framework of its own counts as jest."""
    if path.endswith(".py"):
        return sorted(name for name, signs in PYTHON.items() if any(s in text for s in signs))
    found = {name for name, signs in (SCRIPT | SCRIPT_TESTS).items() if any(s in text for s in signs)}
    if not found & set(SCRIPT_TESTS) and any(c in text for c in TEST_CALLS):
        found.add("jest")
    return sorted(found)


def signals(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The names, in order, of the rules of which a text holds one of the signs: frameworks_of() as a column."""
    holds = lambda signs: reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])
    return F.array_compact(F.array(*[F.when(holds(signs), F.lit(name)) for name, signs in sorted(rules.items())]))


def of_route(var: str | None, url: str, methods: list[str], frameworks: list[str]) -> str:
    """The framework that a Python route most likely belongs to."""
    if not var and not url:
        return "django"
    for name, label in (("flask", "flask"), ("django-ninja", "django-ninja"), ("fastapi", "fastapi"), ("django", "django"), ("django-rest-framework", "django")):
        if name in frameworks:
            return label
    return "fastapi" if var and methods else ""
