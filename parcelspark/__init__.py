"""parcelspark: land-parcel layout analytics on Spark DataFrames."""
