"""Website-content enrichment as Spark jobs.

Tables in, tables out: ``sites`` and ``fetches`` become one enriched row per
site.  Column functions live in :mod:`sitewise.functions`, table operators in
:mod:`sitewise.operators`, readers and writers in :mod:`sitewise.sources`,
compositions in :mod:`sitewise.plans` and the incremental jobs in
:mod:`sitewise.streaming`.
"""

__version__ = "0.1.0"
