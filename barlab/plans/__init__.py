"""Registered queries over the driver tables."""

from barlab.plans import basics, models, prices, studies

ALL_QUERIES = {**studies.QUERIES, **prices.QUERIES, **models.QUERIES, **basics.QUERIES}
