"""All queries of the library apart from those of the text subpackage."""

from tallgrass.plans import analysis, basics, core_problems, grouped, latent, modelled, panels, relational, scores, textual

MODULES = (core_problems, relational, grouped, analysis, textual, modelled, panels, basics, scores, latent)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
