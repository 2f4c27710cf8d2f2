"""chatvitals: Spark-native scoring of group-chat health, from export files to ranked reports."""
