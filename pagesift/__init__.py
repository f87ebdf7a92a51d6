"""pagesift: map-listing page extraction as Spark table jobs.

Input is a table (or stream) of captured HTML page snapshots; output is four
linked entity tables (search results, places, reviews, photos) plus a progress
ledger.  All heavy work is expressed with DataFrame / SQL column expressions so
Catalyst plans it and Tungsten runs it inside whole-stage codegen where it can.
"""

__version__ = "0.1.0"
