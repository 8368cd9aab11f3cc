"""Imports every module that registers queries."""

from lodestar.operators import cells, enrichment, entities, evaluation, events, evidence, fusion, grounding, ingestion, mappings, numbers, passages, phrases, planning, relational, research, retrieval, selection, synthesis, texts, upserts
from lodestar.plans.registry import ORACLES, QUERIES
from lodestar.streaming import keyed

__all__ = ["ORACLES", "QUERIES", "cells", "enrichment", "entities", "evaluation", "events", "evidence", "fusion", "grounding", "ingestion", "keyed", "mappings", "numbers", "passages", "phrases", "planning", "relational", "research", "retrieval", "selection", "synthesis", "texts", "upserts"]
