"""lexgrain: labelled-text analytics on Spark DataFrames.

The package is organised by role:

* ``functions``  column expressions (cleaning, tokens, softmax, log scraping)
* ``sources``    readers and sinks for corpora, predictions and fold outputs
* ``operators``  DataFrame -> DataFrame transformations
* ``plans``      complete workflows, plus the relations and queries of the driver contract
* ``streaming``  notes on using the row expressions on streams
"""

__version__ = "0.1.0"
