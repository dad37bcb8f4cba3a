"""nearfold: exact group-nearest-neighbour analytics expressed as Spark plans."""
