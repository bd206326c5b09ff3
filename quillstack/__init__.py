"""quillstack: retrieval and graph analytics over document libraries, as Spark plans."""
