"""skywarden: network and drone threat analytics as Spark plans."""
