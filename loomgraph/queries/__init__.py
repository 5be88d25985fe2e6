"""Named queries: name -> (function of a session and a folder of tables, SQL that gives the same rows or None)."""


def all_registries():
    from loomgraph.queries import assorted, flowing, graphed, learning, pipeline, profiled, reported, texted

    return [pipeline.R, learning.R, profiled.R, graphed.R, texted.R, flowing.R, reported.R, assorted.R]
